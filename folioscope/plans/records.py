"""Record hierarchy: merges, sections, chunks, evidence units, text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions import vectors as V
from folioscope.operators import records as O
from folioscope.plans.common import sql_squash, sql_text, sql_tokens, table


def keep_first_merge(s: SparkSession, d: str) -> DataFrame:
    """Papers of all ingestions, the first of an id kept; the release is the month of ingestion."""
    p = table(s, d, "papers").select("paper_id", "corpus_key", "title", "year", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("release"))
    return O.keep_first(p, "paper_id", "release")


def merge_lineage(s: SparkSession, d: str) -> DataFrame:
    """How many rows of each corpus were kept and how many dropped as repeated ids."""
    p = table(s, d, "papers")
    return p.groupBy("corpus_key").agg(F.count("*").alias("n_rows"), F.countDistinct("paper_id").alias("n_papers"), (F.count("*") - F.countDistinct("paper_id")).alias("n_repeated"))


def latest_rows(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks").select("chunk_id", "paper_id", "token_count", "page_start", "ingested_at")
    return O.latest(c, "chunk_id", "ingested_at").withColumn("ingested_at", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss"))


def enrichment_upsert(s: SparkSession, d: str) -> DataFrame:
    """Listing titles overlaid with the extracted ones; papers without extraction keep theirs."""
    old = O.latest(table(s, d, "papers").select("paper_id", "title", "year", "ingested_at"), "paper_id", "ingested_at").select("paper_id", "title", "year")
    new = O.latest(table(s, d, "header_results").select("paper_id", "title", F.size(F.coalesce("affiliations", F.array().cast("array<string>"))).alias("n_affiliations"), "extracted_at"), "paper_id", "extracted_at").select("paper_id", "title", "n_affiliations")
    return O.upsert(old, new, "paper_id")


def queued_papers(s: SparkSession, d: str) -> DataFrame:
    """Papers that have no header result yet."""
    return table(s, d, "papers").select("paper_id", "corpus_key").distinct().join(table(s, d, "header_results").select("paper_id"), "paper_id", "left_anti")


def word_windows(s: SparkSession, d: str) -> DataFrame:
    w = O.windows(table(s, d, "documents"), "doc_id", T.tokens("text"), 120, 30)
    return w.select("doc_id", "window_no", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.md5("text").alias("text_md5"))


def _sections(s: SparkSession, d: str) -> DataFrame:
    return O.latest(table(s, d, "sections"), "section_id", "ingested_at")


def _objects(s: SparkSession, d: str) -> DataFrame:
    return O.latest(table(s, d, "layout_objects"), "object_id", "ingested_at")


def forward_fill_sections(s: SparkSession, d: str) -> DataFrame:
    """Objects of a paper under the last table before them, tables standing in for headings."""
    o = _objects(s, d).select("paper_id", "object_id", F.concat_ws("-", F.format_string("%06d", "ordinal"), "object_id").alias("o"), (F.col("object_type") == "table_block").alias("is_heading"), "caption")
    return O.forward_fill(o, "paper_id", "o", "is_heading", "caption").select("paper_id", "object_id", "section_no", "section_title")


def references_cut(s: SparkSession, d: str) -> DataFrame:
    """Sections before the first heading that opens the references."""
    x = _sections(s, d).select("paper_id", "section_id", F.concat_ws("-", F.format_string("%06d", "ordinal"), "section_id").alias("o"), F.when(F.col("ordinal") % 5 == 4, "References and notes").otherwise(F.col("section_title")).alias("h"))
    return O.until_references(x, "paper_id", "o", "h").select("paper_id", "section_id")


def heading_paths(s: SparkSession, d: str) -> DataFrame:
    x = _sections(s, d).select("paper_id", "section_id", _order().alias("o"), F.least(F.lit(4), F.greatest(F.lit(1), F.coalesce("level", F.lit(1)))).alias("lv"), F.coalesce("section_title", F.lit("")).alias("section_title"))
    return O.section_paths(x, "paper_id", "o", "lv", "section_title").select("paper_id", "section_id", F.size("path").alias("depth"), F.array_join("path", " > ").alias("path"), "parent_order")


def _order() -> Column:
    return F.concat_ws("-", F.format_string("%06d", "ordinal"), "section_id")


def char_offsets(s: SparkSession, d: str) -> DataFrame:
    x = _sections(s, d).select("paper_id", "section_id", _order().alias("o"), "section_title", "text")
    return O.char_offsets(x, "paper_id", "o", "section_title", "text").select("paper_id", "section_id", F.col("text_start").cast("bigint").alias("text_start"), F.col("text_end").cast("bigint").alias("text_end"))


def section_members(s: SparkSession, d: str) -> DataFrame:
    m = O.section_members(_objects(s, d).where("section_id IS NOT NULL"), "section_id", "ordinal")
    return m.select("section_id", F.md5("text").alias("text_md5"), F.md5("text_summary").alias("summary_md5"), "page_start", "page_end", F.size("member_object_ids").alias("n_members"))


def packed_chunks(s: SparkSession, d: str) -> DataFrame:
    c = O.pack_chunks(_objects(s, d))
    return c.withColumn("text_md5", F.md5("text")).drop("text").withColumn("member_object_ids", F.array_join("member_object_ids", "|"))


def packed_offsets(s: SparkSession, d: str) -> DataFrame:
    """Packed chunks in the text of their sections, which keeps its own white space: not every chunk is found."""
    sec = O.char_offsets(_sections(s, d).withColumn("o", _order()), "paper_id", "o", "section_title", "text")
    return O.chunk_offsets(O.pack_chunks(_objects(s, d)), sec)


def evidence_units(s: SparkSession, d: str) -> DataFrame:
    chunks = O.latest(table(s, d, "chunks"), "chunk_id", "ingested_at")
    u = O.evidence_units(_sections(s, d), _objects(s, d), chunks, table(s, d, "papers"))
    return u.select("evidence_id", "paper_id", "evidence_type", "section_id", "section_kind", F.length("text").alias("n_chars"), F.size("object_ids").alias("n_objects"), F.size("chunk_ids").alias("n_chunks"))


def evidence_core(s: SparkSession, d: str) -> DataFrame:
    return evidence_units(s, d).where("evidence_type <> 'list_item_unit'")


def nearest_supplements(s: SparkSession, d: str) -> DataFrame:
    """Text and list blocks with the nearest unused table or figure of their page, one to one."""
    o = _objects(s, d).where(F.size(F.coalesce("bbox", F.array().cast("array<double>"))) == 4).withColumn("block_type", F.lit("x"))
    blocks = o.where("object_type IN ('text_block', 'list_block')").select("paper_id", F.col("object_id").alias("block_id"), "ordinal", "block_type", "page_idx", "bbox")
    extra = o.where("object_type IN ('table_block', 'figure_block')").select("paper_id", F.col("object_id").alias("supplement_id"), "block_type", "page_idx", "bbox")
    return O.nearest_supplements(blocks, extra, "paper_id").withColumn("distance", F.round("distance", 6))


def box_distances(s: SparkSession, d: str) -> DataFrame:
    o = _objects(s, d).select("object_id", "caption", "page_idx", V.box("bbox").alias("b"))
    page = F.array(*[F.lit(x) for x in (0.0, 0.0, 612.0, 792.0)])
    return o.where(F.size("b") == 4).select("object_id", F.round(V.box_distance("b", page), 6).alias("from_centre"), F.round(V.figure_score("caption", "page_idx", "b"), 6).alias("figure_score"))


def keyword_topk(s: SparkSession, d: str) -> DataFrame:
    p = O.latest(table(s, d, "papers").select("paper_id", "abstract", "ingested_at"), "paper_id", "ingested_at")
    return O.keywords(p, "paper_id", T.tokens("abstract"), 12)


def paper_statistics(s: SparkSession, d: str) -> DataFrame:
    return O.paper_statistics(_objects(s, d))


def overlap_dedupe(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "evidence_units").dropDuplicates(["evidence_id"])
    return O.overlap_duplicates(u, ["paper_id"], "evidence_id", "text", "page_start", "page_end").select("evidence_id", "paper_id")


def deduped_headings(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "sections").select("paper_id", "section_title", F.concat_ws("-", F.format_string("%06d", "ordinal"), "section_id").alias("o")).distinct()
    return O.dedupe_text(x, ["paper_id"], "section_title", "o", lambda c: F.lower(T.squash(c))).select("paper_id", F.lower(T.squash("section_title")).alias("heading"))


def typed_evidence(s: SparkSession, d: str) -> DataFrame:
    """(section_id, evidence_type, score, selected) of every section and type that scores."""
    x = _sections(s, d).select("section_id", T.evidence_scores("section_title", F.array_join("section_path", " "), "text").alias("m"))
    return x.select("section_id", F.explode("m").alias("evidence_type", "score")).withColumn("selected", F.col("score") >= 0.35)


def typed_evidence_counts(s: SparkSession, d: str) -> DataFrame:
    x = _sections(s, d).select("paper_id", T.evidence_scores("section_title", F.array_join("section_path", " "), "text").alias("m"))
    return x.select("paper_id", F.explode("m").alias("evidence_type", "score")).where("score >= 0.35").groupBy("paper_id", "evidence_type").agg(F.count("*").alias("n"))


def heading_levels(s: SparkSession, d: str) -> DataFrame:
    h = F.concat_ws(" ", F.when(F.col("ordinal") % 3 == 0, F.concat(F.col("ordinal").cast("string"), F.lit(".2"))).when(F.col("ordinal") % 3 == 1, "Appendix").otherwise(F.lit("B. ")), "section_title")
    x = _sections(s, d).select("section_id", h.alias("h"))
    return x.select("section_id", T.heading_level("h").alias("level"), T.is_reference_heading("h").alias("is_reference"), T.slug("h").alias("slug"), T.truncate("h", 20).alias("short"))


def stable_ids(s: SparkSession, d: str) -> DataFrame:
    x = _objects(s, d)
    return x.select("object_id", T.stable_id("object", "paper_id", "ordinal", "object_type", "page_idx", F.substring("text", 1, 80)).alias("stable_id"))


def section_priors(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "eval_items").select("item_id", T.section_priors(F.concat(F.lit("Which method and dataset, compare limitation: "), F.col("text"))).alias("p"))
    return x.select("item_id", F.array_join("p", ",").alias("labels"), F.array_join(T.expand_priors("p"), ",").alias("headings"))


def reference_fields(s: SparkSession, d: str) -> DataFrame:
    """Year, DOI, arXiv id and address out of reference strings made of the papers' own fields."""
    p = O.latest(table(s, d, "papers").select("paper_id", "title", "year", "doi", "url", "ingested_at"), "paper_id", "ingested_at")
    ref = F.concat_ws(" ", "title", F.concat(F.lit("("), F.col("year").cast("string"), F.lit(").")), F.concat(F.lit("doi:"), F.col("doi"), F.lit(".")), F.concat(F.lit("arXiv:"), F.col("year").cast("string"), F.lit(".01234v2")), F.concat(F.col("url"), F.lit(").")))
    return p.select("paper_id", ref.alias("r")).select("paper_id", T.reference_year("r").alias("year"), T.reference_doi("r").alias("doi"), T.reference_arxiv("r").alias("arxiv_id"), T.reference_url("r").alias("url"))


def list_item_units(s: SparkSession, d: str) -> DataFrame:
    o = _objects(s, d).where("object_type = 'list_block'")
    return o.select("object_id", F.posexplode(T.list_items("text")).alias("pos", "item")).select("object_id", "pos", F.md5("item").alias("item_md5"))


def table_text(s: SparkSession, d: str) -> DataFrame:
    return _objects(s, d).where("html <> ''").select("object_id", T.html_text("html").alias("plain"))


def table_cells(s: SparkSession, d: str) -> DataFrame:
    from folioscope.sources.markup import html_table

    o = _objects(s, d).where("object_type = 'table_block' AND text <> ''").select("object_id", F.concat(F.lit("<table><tr><td>"), F.regexp_replace(F.regexp_replace("text", "[\t|]", "</td><td>"), "\n", "</td></tr><tr><td>"), F.lit("</td></tr></table>")).alias("h"))
    return o.select("object_id", F.explode(html_table("h")).alias("c")).select("object_id", "c.row", "c.col", "c.text")


def rationale_points(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_items").select("item_id", T.main_reason("text").alias("main_reason"), F.size(T.matching_points("text")).alias("n_points"))


def corpus_keys(s: SparkSession, d: str) -> DataFrame:
    p = O.latest(table(s, d, "papers").select("paper_id", "venue", "year", "track", "ingested_at"), "paper_id", "ingested_at")
    return p.select("paper_id", T.corpus_key("venue", "year", "track").alias("corpus_key"), T.track_of("track").alias("track"))


def matched_sections(s: SparkSession, d: str) -> DataFrame:
    """Section titles by how often they occur in a paper, ranked by count and title."""
    x = table(s, d, "sections").select("paper_id", "section_id", T.squash("section_title").alias("title")).distinct().where("title <> ''")
    c = x.groupBy("paper_id", "title").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("n"), F.lower("title"), "title")))


QUERIES = {
    f.__name__: f
    for f in (
        keep_first_merge, merge_lineage, latest_rows, enrichment_upsert, queued_papers, word_windows, forward_fill_sections, references_cut, heading_paths, char_offsets, section_members,
        packed_chunks, packed_offsets, evidence_units, evidence_core, nearest_supplements, box_distances, keyword_topk, paper_statistics, overlap_dedupe, deduped_headings, typed_evidence, typed_evidence_counts,
        heading_levels, stable_ids, section_priors, reference_fields, list_item_units, table_text, table_cells, rationale_points, corpus_keys, matched_sections,
    )
}


def _sql_latest(name: str, key: str, at: str = "ingested_at") -> str:
    return f"(SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {at} DESC) = 1)"


_SEC = _sql_latest("sections", "section_id")
_OBJ = _sql_latest("layout_objects", "object_id")
_CHK = _sql_latest("chunks", "chunk_id")
_PAP = _sql_latest("papers", "paper_id")
_ORD = "printf('%06d', ordinal) || '-' || section_id"
_PLAIN = sql_squash("replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')")


def _sql_evidence_scores(source: str, keys: str) -> str:
    parts = []
    for name, (heads, texts) in T.EVIDENCE_CUES.items():
        h = " OR ".join(f"contains(h, {sql_text(x)})" for x in heads)
        n = " + ".join(f"contains(b, {sql_text(x)})::INT" for x in texts)
        score = f"CASE WHEN {h} THEN 0.55 ELSE 0.0 END::DOUBLE + least(0.45, ({n}) * 0.15)::DOUBLE"
        if name == "appendix":
            score = f"CASE WHEN contains(h, 'appendix') OR contains(h, 'supplementary') THEN greatest({score}, 0.9) ELSE {score} END"
        parts.append(f"SELECT {keys}, {sql_text(name)} AS evidence_type, round(least({score}, 1.0), 4)::DOUBLE AS score FROM hb")
    head = sql_squash("concat_ws(' ', section_title, array_to_string(section_path, ' '))")
    body = sql_squash("coalesce(text, '')")
    return f"WITH hb AS (SELECT {keys}, lower({head}) AS h, lower({body}) AS b FROM {source}), allscores AS ({' UNION ALL '.join(parts)}) "


_SQUASHED = sql_squash("string_agg(t, chr(10) || chr(10) ORDER BY ordinal, object_id) FILTER (t <> '')")
_SHORT = lambda c, n: f"CASE WHEN length({c}) <= {n} THEN {c} ELSE rtrim(substr({c}, 1, {n - 3})) || '...' END"

#: Packing object by object: buf and bufn hold the open buffer, e1 and e2 what the step closed.
_PACK = f"""
o AS (SELECT section_id, paper_id, object_id, object_type AS k, coalesce(page_idx, 0) AS pg, coalesce(text, '') AS tx, len({sql_tokens('text')}) AS n, row_number() OVER (PARTITION BY section_id ORDER BY ordinal, object_id) AS i FROM {_OBJ} WHERE section_id IS NOT NULL),
walk AS (
  SELECT DISTINCT section_id, 0::BIGINT AS i, []::BIGINT[] AS buf, []::BIGINT[] AS bufn, []::BIGINT[] AS e1, []::BIGINT[] AS e2 FROM o
  UNION ALL
  SELECT section_id, i,
    CASE WHEN skip THEN buf WHEN alone THEN [] WHEN full_ THEN list_append(buf[j:], i) ELSE list_append(buf, i) END,
    CASE WHEN skip THEN bufn WHEN alone THEN [] WHEN full_ THEN list_append(bufn[j:], n) ELSE list_append(bufn, n) END,
    CASE WHEN NOT skip AND (alone OR full_) THEN buf ELSE [] END,
    CASE WHEN NOT skip AND alone THEN [i] ELSE [] END
  FROM (SELECT w.section_id, o.i, o.n, w.buf, w.bufn,
      o.k = 'equation_block' OR (o.k IN ('text_block', 'list_block') AND o.n = 0) AS skip,
      o.k NOT IN ('text_block', 'list_block', 'equation_block') AS alone,
      len(w.buf) > 0 AND list_sum(w.bufn) + o.n > 420 AND list_sum(w.bufn) >= 210 AS full_,
      list_min(list_filter(range(1, len(w.bufn) + 1), lambda x: coalesce(list_sum(w.bufn[x + 1:]), 0) < 63)) AS j
    FROM walk w JOIN o ON o.section_id = w.section_id AND o.i = w.i + 1)
),
closed AS (
  SELECT section_id, i, 1 AS e, e1 AS ids FROM walk WHERE len(e1) > 0 UNION ALL SELECT section_id, i, 2, e2 FROM walk WHERE len(e2) > 0
  UNION ALL SELECT section_id, i, 3, buf FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY i DESC) = 1) WHERE len(buf) > 0
),
members AS (SELECT section_id, row_number() OVER (PARTITION BY section_id ORDER BY i, e) - 1 AS chunk_no, ids FROM closed),
flat AS (SELECT m.section_id, m.chunk_no, o.* EXCLUDE (section_id) FROM (SELECT section_id, chunk_no, unnest(ids) AS i FROM members) m JOIN o USING (section_id, i)),
packed AS (SELECT *, 'chunk_' || substr(sha1(concat_ws(':', paper_id, section_id, chunk_type, page_start, page_end, member_object_ids)), 1, 16) AS chunk_id FROM (
  SELECT any_value(paper_id) AS paper_id, section_id, chunk_no::INT AS chunk_no, CASE arg_min(k, i) WHEN 'table_block' THEN 'table_chunk' WHEN 'text_block' THEN 'text_chunk' WHEN 'list_block' THEN 'text_chunk' ELSE 'figure_chunk' END AS chunk_type,
    min(pg) AS page_start, max(pg) AS page_end, string_agg(object_id, '|' ORDER BY i) AS member_object_ids,
    CASE WHEN arg_min(k, i) IN ('text_block', 'list_block') THEN {sql_squash("string_agg(tx, chr(10) || chr(10) ORDER BY i)")} ELSE arg_min(tx, i) END AS text
  FROM flat GROUP BY section_id, chunk_no))"""
_OFFSETS = f"""SELECT paper_id, section_id, text, (coalesce(sum(a + 1 + b + 2) OVER (PARTITION BY paper_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + a + 1)::BIGINT AS text_start, b
FROM (SELECT paper_id, section_id, text, {_ORD} AS o, coalesce(length(section_title), 0) AS a, coalesce(length(text), 0) AS b FROM {_SEC})"""

_PRIORS = "concat_ws(',', " + ", ".join("CASE WHEN " + " OR ".join(f"contains(t, {sql_text(c)})" for c in cues) + f" THEN {sql_text(k)} END" for k, cues in T.PRIOR_CUES.items()) + ")"
_SHA = "substr(sha1({0}), 1, 16)"
_KNOWN = "WHERE paper_id IN (SELECT paper_id FROM papers)"
_APP = "CASE WHEN regexp_matches(concat_ws(' ', section_title, array_to_string(section_path, ' ')), '(?i)\\b(appendix|appendices|supplementary)\\b') THEN 'appendix' ELSE 'body' END"

ORACLE = {
    "keep_first_merge": "SELECT paper_id, corpus_key, title, year, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS release FROM papers QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at) = 1",
    "merge_lineage": "SELECT corpus_key, count(*) AS n_rows, count(DISTINCT paper_id) AS n_papers, count(*) - count(DISTINCT paper_id) AS n_repeated FROM papers GROUP BY corpus_key",
    "latest_rows": f"SELECT chunk_id, paper_id, token_count, page_start, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS ingested_at FROM {_CHK}",
    "enrichment_upsert": f"SELECT coalesce(p.paper_id, h.paper_id) AS paper_id, coalesce(h.title, p.title) AS title, p.year, len(coalesce(h.affiliations, [])) * CASE WHEN h.paper_id IS NULL THEN NULL ELSE 1 END AS n_affiliations FROM {_PAP} p FULL JOIN {_sql_latest('header_results', 'paper_id', 'extracted_at')} h USING (paper_id)",
    "queued_papers": "SELECT DISTINCT paper_id, corpus_key FROM papers WHERE paper_id NOT IN (SELECT paper_id FROM header_results)",
    "word_windows": f"""WITH t AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents), w AS (SELECT doc_id, t, unnest(range(greatest(1, ceil((len(t) - 30) / 90.0)::INT))) AS window_no FROM t WHERE len(t) > 0)
SELECT doc_id, window_no::INT AS window_no, (window_no * 90)::INT AS start, least(len(t), window_no * 90 + 120)::INT AS end, md5(array_to_string(t[window_no * 90 + 1 : window_no * 90 + 120], ' ')) AS text_md5 FROM w""",
    "forward_fill_sections": f"""SELECT paper_id, object_id, (sum((object_type = 'table_block')::INT) OVER w)::BIGINT AS section_no, coalesce(last_value(CASE WHEN object_type = 'table_block' THEN caption END IGNORE NULLS) OVER w, 'Document') AS section_title
FROM {_OBJ} WINDOW w AS (PARTITION BY paper_id ORDER BY printf('%06d', ordinal) || '-' || object_id ROWS UNBOUNDED PRECEDING)""",
    "references_cut": f"SELECT paper_id, section_id FROM (SELECT paper_id, section_id, max((ordinal % 5 = 4)::INT) OVER (PARTITION BY paper_id ORDER BY {_ORD} ROWS UNBOUNDED PRECEDING) AS seen FROM {_SEC}) WHERE seen = 0",
    "char_offsets": f"SELECT paper_id, section_id, text_start, (text_start + b)::BIGINT AS text_end FROM ({_OFFSETS})",
    "section_members": f"""SELECT section_id, md5(t) AS text_md5, md5({_SHORT('t', 900)}) AS summary_md5, page_start, page_end, n_members FROM (
SELECT section_id, coalesce({_SQUASHED}, '') AS t, min(page_idx) AS page_start, max(page_idx) AS page_end, count(*)::INT AS n_members
FROM (SELECT *, CASE WHEN object_type <> 'equation_block' THEN coalesce(text, '') ELSE '' END AS t FROM {_OBJ} WHERE section_id IS NOT NULL) GROUP BY section_id)""",
    "packed_chunks": f"WITH RECURSIVE {_PACK} SELECT paper_id, section_id, chunk_no, chunk_type, page_start, page_end, member_object_ids, len({sql_tokens('text')})::INT AS token_count, chunk_id, md5(text) AS text_md5 FROM packed",
    "packed_offsets": f"""WITH RECURSIVE {_PACK}, c AS (SELECT section_id, chunk_id, text AS c, row_number() OVER (PARTITION BY section_id ORDER BY chunk_no) AS i FROM packed), sec AS (SELECT * FROM ({_OFFSETS}) WHERE coalesce(text, '') <> ''),
go AS (
  SELECT section_id, 0::BIGINT AS i, 0::BIGINT AS cursor, ''::VARCHAR AS chunk_id, 0::BIGINT AS s, 0::BIGINT AS n FROM sec
  UNION ALL
  SELECT section_id, i, CASE WHEN pos_ >= 0 THEN pos_ + 1 ELSE cursor END, chunk_id, greatest(pos_, 0), CASE WHEN pos_ >= 0 THEN length(c) ELSE least(length(c), length(text)) END
  FROM (SELECT g.section_id, c.i, g.cursor, c.chunk_id, c.c, sec.text,
      CASE WHEN c.c = '' THEN CASE WHEN g.cursor <= length(sec.text) THEN g.cursor ELSE 0 END WHEN instr(substr(sec.text, g.cursor + 1), c.c) > 0 THEN g.cursor + instr(substr(sec.text, g.cursor + 1), c.c) - 1 ELSE instr(sec.text, c.c) - 1 END AS pos_
    FROM go g JOIN c ON c.section_id = g.section_id AND c.i = g.i + 1 JOIN sec ON sec.section_id = g.section_id)
)
SELECT go.section_id, chunk_id, (text_start + s)::BIGINT AS char_start, (text_start + s + n)::BIGINT AS char_end FROM go JOIN sec USING (section_id) WHERE i > 0""",
    "heading_paths": f"""WITH x AS (SELECT paper_id, section_id, {_ORD} AS o, least(4, greatest(1, coalesce(level, 1))) AS lv, coalesce(section_title, '') AS t FROM {_SEC}),
open_ AS (SELECT s.paper_id, s.section_id, s.o, a.o AS ao, a.t FROM x s JOIN x a ON a.paper_id = s.paper_id AND a.o <= s.o WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.paper_id = s.paper_id AND b.o > a.o AND b.o <= s.o AND b.lv <= a.lv))
SELECT paper_id, section_id, count(*)::INT AS depth, string_agg(t, ' > ' ORDER BY ao) AS path, max(ao) FILTER (ao < o) AS parent_order FROM open_ GROUP BY paper_id, section_id""",
    "evidence_core": f"""WITH s AS (SELECT *, {_APP} AS section_kind FROM {_SEC} {_KNOWN}), o AS (SELECT * FROM {_OBJ} WHERE text <> ''), c AS (SELECT * FROM {_CHK} WHERE text <> '')
SELECT 'evidence_' || {_SHA.format("s.paper_id || ':' || s.section_id || ':section'")} AS evidence_id, paper_id, 'section_unit' AS evidence_type, section_id, section_kind, length(text) AS n_chars, len(coalesce(member_object_ids, [])) AS n_objects, len(coalesce(member_chunk_ids, [])) AS n_chunks FROM s WHERE text <> ''
UNION ALL SELECT 'evidence_' || {_SHA.format("s.paper_id || ':' || o.object_id || CASE o.object_type WHEN 'text_block' THEN ':paragraph' WHEN 'list_block' THEN ':list' ELSE ':table' END")}, s.paper_id, CASE o.object_type WHEN 'text_block' THEN 'paragraph_unit' WHEN 'list_block' THEN 'list_unit' ELSE 'table_unit' END, s.section_id, s.section_kind, length(o.text), 1, 0 FROM s JOIN o ON s.section_id = o.section_id WHERE o.object_type IN ('text_block', 'list_block', 'table_block')
UNION ALL SELECT 'evidence_' || {_SHA.format("s.paper_id || ':' || c.chunk_id || ':chunk'")}, s.paper_id, 'chunk_unit', s.section_id, s.section_kind, length(c.text), len(coalesce(c.member_object_ids, [])), 1 FROM s JOIN c ON s.section_id = c.section_id""",
    "box_distances": f"""SELECT object_id, round(sqrt(power((bbox[1] + bbox[3] - 612.0) / 2, 2) + power((bbox[2] + bbox[4] - 792.0) / 2, 2)), 6) AS from_centre,
round(10.0 + CASE WHEN trim(coalesce(caption, '')) <> '' THEN 3.0 ELSE 0 END + greatest(0.0, 4.0 - page_idx) * 0.8 + least(greatest(0.0, bbox[3] - bbox[1]) * greatest(0.0, bbox[4] - bbox[2]), 1e6) / 1e5
+ 1.5 * ({' + '.join(f"contains(lower(trim(coalesce(caption, ''))), {sql_text(k)})::INT" for k in ('figure 1', 'overview', 'architecture', 'framework', 'pipeline', 'system overview'))}), 6) AS figure_score FROM {_OBJ} WHERE len(bbox) = 4""",
    "keyword_topk": f"""WITH t AS (SELECT paper_id, unnest({sql_tokens('abstract')}) AS term, generate_subscripts({sql_tokens('abstract')}, 1) AS pos FROM {_PAP})
SELECT * FROM (SELECT paper_id, term, count(*) AS n, row_number() OVER (PARTITION BY paper_id ORDER BY count(*) DESC, min(pos)) AS rank FROM t GROUP BY paper_id, term) WHERE rank <= 12""",
    "paper_statistics": f"SELECT paper_id, max(page_idx) AS pages, count(*) FILTER (object_type = 'figure_block') AS figures, arg_min(image_path, (page_idx, ordinal, object_id)) FILTER (object_type = 'figure_block' AND image_path <> '') AS first_figure FROM {_OBJ} GROUP BY paper_id",
    "overlap_dedupe": f"""WITH u AS (SELECT DISTINCT evidence_id, paper_id, page_start, page_end, lower({sql_squash('text')}) AS t FROM evidence_units)
SELECT evidence_id, paper_id FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE a.paper_id = b.paper_id AND a.evidence_id <> b.evidence_id AND a.page_start <= b.page_end AND b.page_start <= a.page_end AND contains(b.t, a.t) AND (length(b.t) > length(a.t) OR (a.t = b.t AND b.evidence_id < a.evidence_id)))""",
    "deduped_headings": f"SELECT DISTINCT paper_id, lower({sql_squash('section_title')}) AS heading FROM sections WHERE {sql_squash('section_title')} <> ''",
    "typed_evidence": _sql_evidence_scores(_SEC, "section_id") + "SELECT section_id, evidence_type, score, score >= 0.35 AS selected FROM allscores WHERE score > 0",
    "typed_evidence_counts": _sql_evidence_scores(_SEC, "paper_id, section_id") + "SELECT paper_id, evidence_type, count(*) AS n FROM allscores WHERE score >= 0.35 GROUP BY ALL",
    "heading_levels": f"""WITH h AS (SELECT section_id, concat_ws(' ', CASE ordinal % 3 WHEN 0 THEN ordinal || '.2' WHEN 1 THEN 'Appendix' ELSE 'B. ' END, section_title) AS h FROM {_SEC})
SELECT section_id, CASE WHEN regexp_matches(h, '^\\d') THEN 2 WHEN h LIKE 'Appendix%' THEN 1 ELSE 2 END::INT AS level, regexp_matches(trim(regexp_replace(regexp_replace(h, '^\\d+(\\.\\d+)*\\s*', ''), '\\s+', ' ', 'g')), '(?i)^(?:acknowledge?ments?\\s+and\\s+)?(?:references?|bibliography|works cited)(?:\\s+and\\s+.*)?$') AS is_reference,
regexp_replace(substr(regexp_replace(regexp_replace(lower(h), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '-+$', '') AS slug, CASE WHEN length(h) <= 20 THEN h ELSE rtrim(substr(h, 1, 17)) || '...' END AS short FROM h""",
    "stable_ids": f"SELECT object_id, 'object_' || substr(sha1(concat_ws(':', coalesce(paper_id, ''), coalesce(ordinal::VARCHAR, ''), coalesce(object_type, ''), coalesce(page_idx::VARCHAR, ''), coalesce(substr(text, 1, 80), ''))), 1, 16) AS stable_id FROM {_OBJ}",
    "reference_fields": f"SELECT paper_id, coalesce(try_cast(nullif(regexp_extract(title, '\\b((?:19|20)\\d{{2}})[a-z]?\\b', 1), '') AS INT), year) AS year, doi, year || '.01234' AS arxiv_id, url FROM {_PAP}",
    "table_text": f"SELECT object_id, {_PLAIN} AS plain FROM {_OBJ} WHERE html <> ''",
    "table_cells": f"""WITH r AS (SELECT object_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM {_OBJ} WHERE object_type = 'table_block' AND text <> '')
SELECT object_id, row::INT AS row, (generate_subscripts(regexp_split_to_array(line, '[\\t|]'), 1) - 1)::INT AS col, {sql_squash("unnest(regexp_split_to_array(line, '[\\t|]'))")} AS text FROM r""",
    "corpus_keys": f"SELECT paper_id, concat_ws('/', lower(coalesce(venue, '')), year::VARCHAR, lower(coalesce(track, 'unknown'))) AS corpus_key, CASE WHEN x IN ('main', 'long') THEN 'long' WHEN x LIKE 'short%' THEN 'short' WHEN x LIKE 'demo%' THEN 'demo' WHEN x = '' THEN 'unknown' ELSE x END AS track FROM (SELECT *, regexp_extract(lower(trim(coalesce(track, ''))), '([^-.]*)$', 1) AS x FROM {_PAP})",
    "matched_sections": f"SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, lower(title), title) AS rank FROM (SELECT paper_id, title, count(*) AS n FROM (SELECT DISTINCT paper_id, section_id, {sql_squash('section_title')} AS title FROM sections) WHERE title <> '' GROUP BY ALL)",
    "section_priors": f"""WITH t AS (SELECT item_id, lower('Which method and dataset, compare limitation: ' || text) AS t FROM eval_items), l AS (SELECT item_id, string_split({_PRIORS}, ',') AS ls FROM t),
m(k, hs) AS (VALUES {', '.join(f"({sql_text(k)}, [{', '.join(sql_text(x) for x in v)}])" for k, v in T.SECTION_PRIORS.items())}),
e AS (SELECT item_id, unnest(hs) AS h, li * 100 + generate_subscripts(hs, 1) AS o FROM (SELECT item_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS li FROM l) JOIN m ON x = k)
SELECT item_id, array_to_string(any_value(ls), ',') AS labels, string_agg(h, ',' ORDER BY o) AS headings FROM (SELECT item_id, h, min(o) AS o FROM e GROUP BY ALL) JOIN l USING (item_id) GROUP BY item_id""",
}
