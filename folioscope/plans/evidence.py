"""Evidence of papers: search texts, buckets for competing readings, places in the document, parse states, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import evaluation as V
from folioscope.operators import evidence as E
from folioscope.operators import navigation as N
from folioscope.operators import planning as G
from folioscope.operators import projections as P
from folioscope.operators import qa as QA
from folioscope.operators import ranking as R
from folioscope.operators import records as O
from folioscope.plans.common import SPACE, sql_ascii_tokens, sql_squash, sql_text, sql_tokens, table


def _of(s: SparkSession, d: str, name: str, key: str) -> DataFrame:
    return O.latest(table(s, d, name), key, "ingested_at")


def _papers(s: SparkSession, d: str) -> DataFrame:
    return _of(s, d, "papers", "paper_id")


def _units(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "evidence_units").dropDuplicates(["evidence_id"])


def evidence_texts(s: SparkSession, d: str) -> DataFrame:
    r = E.runtime_rows(_units(s, d), _of(s, d, "sections", "section_id"))
    return r.select("paper_id", "position", "evidence_id", F.md5("search_text").alias("text_md5"))


def paper_search_texts(s: SparkSession, d: str) -> DataFrame:
    """Paper search texts with headings, introduction, keywords and evidence types, as the index holds them."""
    from folioscope.operators.search import make_index

    return make_index(table(s, d, "papers"), table(s, d, "sections"), table(s, d, "chunks")).papers.select("paper_id", F.md5("search_text").alias("text_md5"))


def intro_summaries(s: SparkSession, d: str) -> DataFrame:
    return P.intro_summaries(_papers(s, d), _of(s, d, "sections", "section_id")).select("paper_id", F.md5("intro_summary").alias("summary_md5"))


def encoder_views(s: SparkSession, d: str) -> DataFrame:
    return _papers(s, d).select("paper_id", F.md5(P.separated_view("title", "abstract")).alias("separated_md5"), F.md5(P.contents_view("title", "text")).alias("contents_md5"))


def hypotheses(s: SparkSession, d: str) -> DataFrame:
    """Two readings per paper: what it is about, by its title, and what it reports, by its keywords."""
    p = _papers(s, d).select("paper_id", F.coalesce("title", F.lit("")).alias("title"), F.concat_ws(" ", "title", F.array_join("keywords", " ")).alias("words"))
    types = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    a = p.select(F.concat("paper_id", F.lit("#a")).alias("hypothesis_id"), "paper_id", F.col("title").alias("query"), F.lit("summary").alias("relation"), types("table_unit").alias("preferred_types"))
    return a.unionByName(p.select(F.concat("paper_id", F.lit("#b")).alias("hypothesis_id"), "paper_id", F.col("words").alias("query"), F.lit("result_check").alias("relation"), types().alias("preferred_types")))


def _buckets(s: SparkSession, d: str) -> DataFrame:
    return E.buckets(hypotheses(s, d), E.runtime_rows(_units(s, d), _of(s, d, "sections", "section_id")))


def deep_chat_buckets(s: SparkSession, d: str) -> DataFrame:
    return _buckets(s, d).select("hypothesis_id", "bucket", "evidence_id", F.round("fused", 9).alias("fused"), F.round("score", 9).alias("score"), "rank", "returned")


def limited_hypotheses(s: SparkSession, d: str) -> DataFrame:
    """The two questions of a topic that are given most weight, here by their length."""
    h = table(s, d, "eval_items").select("topic", "item_id", F.length("text").alias("priority"), F.col("item_id").alias("position"))
    return E.limit_hypotheses(h, ["topic"], 2).select("topic", "item_id")


def cited_evidence(s: SparkSession, d: str) -> DataFrame:
    """Citations of every paper's answer, which names all its units twice, from the back."""
    u = _units(s, d).select(F.col("paper_id").alias("hypothesis_id"), "evidence_id", "page_start", "page_end", "text", F.lit("").alias("html"))
    ids = F.reverse(F.array_sort(F.collect_list("evidence_id")))
    answers = u.groupBy("hypothesis_id").agg(F.concat(ids, ids).alias("used_evidence_ids")).select(F.col("hypothesis_id").alias("answer_id"), "hypothesis_id", "used_evidence_ids")
    return E.response_evidence(answers, u).select("answer_id", "position", "evidence_id", F.md5("snippet").alias("snippet_md5"), "html")


def competition_outcome(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").groupBy("user_id", F.col("event_type").alias("hypothesis_id"), F.date_format("ts", "HH").alias("evidence_id")).agg(F.round(F.sum(F.coalesce("value", F.lit(0.0))) / 100, 6).alias("score"))
    c = QA.competition_outcome(e, "user_id")
    return c.select("user_id", "hypothesis_id", *[F.round(x, 6).alias(x) for x in ("support", "margin_vs_next", "discriminative_score", "conflicting_score")])


def _objects(s: SparkSession, d: str) -> DataFrame:
    return _of(s, d, "layout_objects", "object_id")


def markdown_targets(s: SparkSession, d: str) -> DataFrame:
    return N.markdown_targets(N.evidence_specs(_units(s, d)), _of(s, d, "sections", "section_id"), _objects(s, d))


def _sizes(s: SparkSession, d: str) -> DataFrame:
    """Page sizes as the furthest corners of the blocks, counted from 0 as layout documents count."""
    b = _objects(s, d).where(F.size("bbox") >= 4).groupBy("paper_id", (F.col("page_idx") - 1).alias("page_idx")).agg(F.max(F.col("bbox")[2]).alias("width"), F.max(F.col("bbox")[3]).alias("height"))
    return N.page_sizes(b, "paper_id")


def page_sizes(s: SparkSession, d: str) -> DataFrame:
    return _sizes(s, d)


def page_rectangles(s: SparkSession, d: str) -> DataFrame:
    r = N.page_rectangles(N.evidence_specs(_units(s, d)), _objects(s, d), _sizes(s, d))
    return r.select("evidence_id", "page", "width", "height", F.size("boxes").alias("n_boxes"), F.col("boxes")[0][0].alias("first_x"), "is_primary")


def object_aliases(s: SparkSession, d: str) -> DataFrame:
    return N.object_aliases(_units(s, d)).select("object_id", F.array_join("evidence_ids", "|").alias("evidence_ids"))


def evidence_by_paper(s: SparkSession, d: str) -> DataFrame:
    x = N.specs_by_paper(N.evidence_specs(_units(s, d)))
    return x.select("paper_id", F.size("specs").alias("n_specs"), F.col("specs")[0]["evidence_id"].alias("first_id"), F.aggregate("specs", F.lit(0), lambda a, x: a + F.size(x["object_ids"])).alias("n_objects"))


def title_sections(s: SparkSession, d: str) -> DataFrame:
    return N.title_sections(_of(s, d, "sections", "section_id"), _papers(s, d))


def viewer_references(s: SparkSession, d: str) -> DataFrame:
    """Reference filter over the texts of a paper's objects."""
    o = _objects(s, d).select("paper_id", F.concat_ws("-", F.format_string("%06d", "ordinal"), "object_id").alias("o"), "text")
    return N.viewer_references(o, "paper_id", "o", "text").select("paper_id", "o", F.md5("raw_text").alias("text_md5"))


def compact_evidence(s: SparkSession, d: str) -> DataFrame:
    o = _objects(s, d).where("object_type <> 'equation_block'").join(_of(s, d, "sections", "section_id").select("section_id", F.col("section_title").alias("heading")), "section_id", "left")
    u = o.select("paper_id", "object_id", "ordinal", "heading", "text", "caption", F.col("image_path").alias("image"), F.col("page_idx").alias("page_start"), F.col("page_idx").alias("page_end"))
    return N.compact_evidence(u, "paper_id", ["page_start", "ordinal", "object_id"]).select("paper_id", "position", "object_id", "heading")


def image_urls(s: SparkSession, d: str) -> DataFrame:
    return _objects(s, d).where("image_path IS NOT NULL AND image_path <> ''").select("object_id", N.image_url("paper_id", "image_path", "/api").alias("url"))


def body_lines(s: SparkSession, d: str) -> DataFrame:
    x = _of(s, d, "sections", "section_id").select("section_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    return x.select("section_id", "pos", T.body_line("line").alias("l")).where("l <> ''").groupBy("section_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("l")).alias("n_chars"))


def metadata_paragraphs(s: SparkSession, d: str) -> DataFrame:
    return _objects(s, d).select("object_id", T.is_metadata_paragraph("text").alias("is_metadata"))


def document_titles(s: SparkSession, d: str) -> DataFrame:
    x = _of(s, d, "sections", "section_id").select("paper_id", F.concat_ws("-", F.format_string("%06d", "ordinal"), "section_id").alias("o"), "section_title", "page_start")
    return O.document_titles(x, "paper_id", "o", "section_title", "page_start")


def pruned_affiliations(s: SparkSession, d: str) -> DataFrame:
    h = table(s, d, "header_results").where("affiliations IS NOT NULL").select("paper_id", F.array_join(T.without_contained("affiliations"), "|").alias("affiliations"))
    return h.distinct()


def source_fields(s: SparkSession, d: str) -> DataFrame:
    fields = {c: c for c in ("title", "abstract", "doi", "url", "local_pdf_path", "text")}
    return _papers(s, d).select("paper_id", F.array_join(T.present_fields(fields), ",").alias("fields"))


def _states(s: SparkSession, d: str) -> DataFrame:
    return O.parse_states(_papers(s, d), table(s, d, "sections"), table(s, d, "layout_objects"), table(s, d, "chunks"))


def parse_states(s: SparkSession, d: str) -> DataFrame:
    return _states(s, d)


def failed_papers(s: SparkSession, d: str) -> DataFrame:
    f = O.failed_papers(_papers(s, d), _states(s, d))
    return f.select("paper_id", "title", "text", F.size("section_ids").alias("n_sections"), F.size("chunk_ids").alias("n_chunks"), "parse_status", "failure_stage", "failure_error")


def grouped_blocks(s: SparkSession, d: str) -> DataFrame:
    g = O.grouped_blocks(_objects(s, d), "paper_id", ["page_idx", "ordinal", "object_id"], "text", "caption")
    return g.select("paper_id", "title", F.size("texts").alias("n_blocks"), F.md5(F.array_join("texts", "\n")).alias("texts_md5"))


def query_slots(s: SparkSession, d: str) -> DataFrame:
    """Items as annotations: their text and topic in two slots; short answers are not done."""
    a = table(s, d, "eval_items").select("item_id", F.when(F.col("kind") == "short_answer", "open").otherwise("done").alias("status"), F.col("text").alias("search_query_1"), F.nullif("topic", F.lit("")).alias("search_query_2"))
    return O.query_slots(a, ["item_id"], "status", ["search_query_1", "search_query_2"]).select("item_id", "query_slot", F.md5("query_text").alias("text_md5"))


def outcome_metrics(s: SparkSession, d: str) -> DataFrame:
    """Events as search jobs: users are topics, kinds the verdict group, the second of the minute the rank."""
    e = table(s, d, "events")
    r = F.second("ts")
    jobs = e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("topic"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("job_status"), F.when(r.between(1, 10), r).alias("target_rank"),
        F.when(F.col("event_type") == "purchase", "satisfied").when(F.col("event_type") == "click", "partial").otherwise("not_returned").alias("target_bucket"), F.col("value").alias("latency"),
    )
    m = V.outcome_metrics(jobs)
    return m.select("topic", "n", "n_completed", "n_failed", *[F.round(c, 6).alias(c) for c in m.columns[4:]])


def bm25_full_ranking(s: SparkSession, d: str) -> DataFrame:
    """Every paper for every question, also with score 0."""
    q = table(s, d, "eval_items").where("kind = 'question'").select("item_id", F.col("text").alias("query"))
    p = _papers(s, d)
    scores = R.bm25(p, "paper_id", T.ascii_tokens(F.concat_ws("\n", "title", "abstract", "text")), q, "item_id", T.ascii_tokens("query")).withColumn("score", F.round("score", 5))
    return R.full_ranking(scores, p, q, "item_id", "paper_id")


def search_progress(s: SparkSession, d: str) -> DataFrame:
    """Events as progress messages of searches."""
    stages = F.array(*[F.lit(x) for x in (*T.STAGES, "completed", "unknown")])
    stage = F.element_at(stages, (F.col("event_id") % 9 + 1).cast("int"))
    return table(s, d, "events").select("event_id", stage.alias("stage"), F.round(T.overall_progress(stage, F.minute("ts"), F.second("ts")), 6).alias("progress"))


def recent_jobs(s: SparkSession, d: str) -> DataFrame:
    """The fifty newest jobs of each user, events standing for jobs."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return table(s, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("rank")).where("rank <= 50")


def constraint_graphs(s: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.lit("ACL or NIPS 2021, no demo without baseline: "), F.col("text"))
    x = table(s, d, "eval_items").select("item_id", G.constraint_graph(q, G.constraints(q)).alias("g"))
    return x.select("item_id", F.array_join("g.operators", ",").alias("operators"), F.array_join(F.transform("g.nodes", lambda n: F.concat_ws("=", n["node_id"], n["value"])), ",").alias("nodes"))


QUERIES = {
    f.__name__: f
    for f in (
        evidence_texts, paper_search_texts, intro_summaries, encoder_views, deep_chat_buckets, limited_hypotheses, cited_evidence, competition_outcome, markdown_targets, page_sizes, page_rectangles, object_aliases, evidence_by_paper,
        title_sections, viewer_references, compact_evidence, image_urls, body_lines, metadata_paragraphs, document_titles, pruned_affiliations, source_fields, parse_states, failed_papers, grouped_blocks, query_slots, outcome_metrics,
        bm25_full_ranking, search_progress, recent_jobs, constraint_graphs,
    )
}


def _latest(name: str, key: str) -> str:
    return f"(SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ingested_at DESC) = 1)"


_PAP, _SEC, _OBJ, _CHK = _latest("papers", "paper_id"), _latest("sections", "section_id"), _latest("layout_objects", "object_id"), _latest("chunks", "chunk_id")
_UNI = "(SELECT * FROM evidence_units QUALIFY row_number() OVER (PARTITION BY evidence_id) = 1)"
_APP = "CASE WHEN regexp_matches(concat_ws(' ', section_title, array_to_string(section_path, ' ')), '(?i)\\b(appendix|appendices|supplementary)\\b') THEN 'appendix' ELSE 'body' END"


def _join(sep: str, *parts: str) -> str:
    return f"array_to_string(list_filter([{', '.join(f"coalesce({p}, '')" for p in parts)}], lambda x: trim(x) <> ''), {sep})"


def _key(c: str) -> str:
    return f"regexp_replace(lower({sql_squash(f"coalesce({c}, '')")}), '[^a-z0-9]+', '', 'g')"


def _short(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE regexp_replace(substr({c}, 1, {n - 3}), '{SPACE}+$', '') || '...' END"


def _lines(c: str) -> str:
    return sql_squash(f"regexp_replace(replace({c}, chr(173), ''), '([A-Za-z])-{SPACE}+([A-Za-z])', '\\1\\2', 'g')")


_ROWS = f"""rws AS (SELECT u.paper_id, u.evidence_id, u.evidence_type, coalesce(u.heading, '') AS heading,
  {_join("' '", "u.heading", "array_to_string(s.section_path, ' ')", "u.text", _join("' '", "replace(u.evidence_type, '_', ' ')", "s.kind"))} AS search_text
  FROM {_UNI} u LEFT JOIN (SELECT section_id, section_path, {_APP} AS kind FROM {_SEC}) s USING (section_id))"""
_STOP = f"({sql_squash('section_title')})"
_SPECS = f"""specs AS (SELECT trim(paper_id) AS paper_id, trim(evidence_id) AS evidence_id, nullif(trim(section_id), '') AS section_id, list_filter(list_transform(coalesce(object_ids, []), lambda x: trim(x)), lambda x: coalesce(x, '') <> '') AS object_ids
  FROM {_UNI} WHERE trim(coalesce(paper_id, '')) <> '' AND trim(coalesce(evidence_id, '')) <> '')"""
_SIZES = f"""raw AS (SELECT paper_id, page_idx - 1 AS page_idx, max(bbox[3]) AS width, max(bbox[4]) AS height FROM {_OBJ} WHERE len(bbox) >= 4 GROUP BY ALL),
sizes AS (SELECT paper_id, page_idx + shift AS page, width, height FROM (SELECT *, CASE WHEN min(page_idx) OVER (PARTITION BY paper_id) = 0 THEN 1 ELSE 0 END AS shift FROM raw WHERE page_idx IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL) WHERE width > 0 AND height > 0)"""


def _sql_selection(name: str, source: str) -> str:
    """Rows of a bucket with their fused score: BM25 inside each hypothesis, cosine of hashed token counts."""
    return f"""
{name}_st AS (SELECT h, count(*) AS n, avg(len(t)) AS avgdl FROM {source} GROUP BY h),
{name}_df AS (SELECT h, term, count(DISTINCT evidence_id) AS n FROM (SELECT h, evidence_id, unnest(t) AS term FROM {source}) GROUP BY ALL),
{name}_raw AS (SELECT d.h, d.term, avgdl, ln(s.n - d.n + 0.5) - ln(d.n + 0.5) AS raw FROM {name}_df d JOIN {name}_st s USING (h)),
{name}_idf AS (SELECT h, term, avgdl, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY h) ELSE raw END AS idf FROM {name}_raw),
{name}_tf AS (SELECT h, evidence_id, term, count(*) AS tf, any_value(dl) AS dl, any_value(q) AS q FROM (SELECT h, evidence_id, len(t) AS dl, q, unnest(t) AS term FROM {source}) GROUP BY ALL),
{name}_bm AS (SELECT h, evidence_id, sum(len(list_filter(q, lambda x: x = term)) * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM {name}_tf JOIN {name}_idf USING (h, term) GROUP BY ALL),
{name}_rk AS (SELECT r.*, row_number() OVER (PARTITION BY h ORDER BY round(coalesce(b.s, 0.0), 9) DESC, evidence_id) AS rs, row_number() OVER (PARTITION BY h ORDER BY sim DESC, evidence_id) AS rd FROM {source} r LEFT JOIN {name}_bm b USING (h, evidence_id)),
{name}_fu AS (SELECT *, CASE WHEN rs <= 16 THEN 0.5 / (60 + rs) ELSE 0.0 END::DOUBLE + CASE WHEN rd <= 16 THEN 0.5 / (60 + rd) ELSE 0.0 END::DOUBLE AS fused FROM {name}_rk),
{name} AS (SELECT * FROM {name}_fu WHERE fused > 0 QUALIFY row_number() OVER (PARTITION BY h ORDER BY round(fused, 12) DESC, evidence_id) <= 16)"""


def _slots(c: str) -> str:
    """Slots of the hashed encoder."""
    return f"list_transform(list_filter(regexp_split_to_array(lower({c}), '{SPACE}+'), lambda x: x <> ''), lambda w: ('0x' || substr(sha256(w), 1, 8))::UBIGINT % 128)"


_BUCKETS = f"""WITH {_ROWS},
hyp AS (SELECT paper_id || '#a' AS h, paper_id, coalesce(title, '') AS query, ['section_unit'] AS broad, ['table_unit', 'paragraph_unit', 'chunk_unit'] AS narrow FROM {_PAP}
  UNION ALL SELECT paper_id || '#b', paper_id, concat_ws(' ', title, array_to_string(keywords, ' ')), ['paragraph_unit'], ['table_unit', 'list_item_unit', 'paragraph_unit'] FROM {_PAP}),
hv AS (SELECT h, {_slots("query")} AS qs FROM hyp), rv AS (SELECT evidence_id, {_slots("search_text")} AS ds FROM rws),
hc AS (SELECT h, slot, count(*)::DOUBLE AS c FROM (SELECT h, unnest(qs) AS slot FROM hv) GROUP BY ALL), rc AS (SELECT evidence_id, slot, count(*)::DOUBLE AS c FROM (SELECT evidence_id, unnest(ds) AS slot FROM rv) GROUP BY ALL),
hn AS (SELECT h, sqrt(sum(c * c)) AS n FROM hc GROUP BY h), rn AS (SELECT evidence_id, sqrt(sum(c * c)) AS n FROM rc GROUP BY evidence_id),
pairs AS (SELECT h, evidence_id FROM hyp JOIN rws USING (paper_id)),
dots AS (SELECT p.h, p.evidence_id, sum(a.c * b.c) AS dot FROM pairs p JOIN hc a ON a.h = p.h JOIN rc b ON b.evidence_id = p.evidence_id AND b.slot = a.slot GROUP BY ALL),
met AS (SELECT hyp.h, r.evidence_id, r.evidence_type, broad, narrow, {sql_tokens("query")} AS q, {sql_tokens("search_text")} AS t, round(coalesce(dot / (hn.n * rn.n), 0.0), 6) AS sim
  FROM hyp JOIN rws r USING (paper_id) LEFT JOIN dots ON dots.h = hyp.h AND dots.evidence_id = r.evidence_id LEFT JOIN hn ON hn.h = hyp.h LEFT JOIN rn ON rn.evidence_id = r.evidence_id),
m1 AS (SELECT * FROM met WHERE evidence_type IN ('section_unit', 'paragraph_unit')),{_sql_selection("g", "m1")},
m2 AS (SELECT * FROM met WHERE evidence_type IN ('paragraph_unit', 'table_unit', 'list_unit', 'list_item_unit', 'chunk_unit') AND (h, evidence_id) NOT IN (SELECT (h, evidence_id) FROM g)),{_sql_selection("l", "m2")},
both_ AS (SELECT h, 'global' AS bucket, evidence_id, fused, round(fused + CASE WHEN list_contains(broad, evidence_type) THEN 0.08 ELSE 0.0 END, 12) AS score, 2 AS k FROM g
  UNION ALL SELECT h, 'local', evidence_id, fused, round(fused + CASE WHEN list_contains(narrow, evidence_type) THEN 0.08 ELSE 0.0 END, 12), 5 FROM l)
SELECT h AS hypothesis_id, bucket, evidence_id, round(fused, 9) AS fused, round(score, 9) AS score, rank, rank <= k AS returned FROM (SELECT *, row_number() OVER (PARTITION BY h, bucket ORDER BY score DESC, evidence_id) AS rank FROM both_)"""

_READ = "rd AS (SELECT user_id, event_type AS h, strftime(ts, '%H') AS e, round(sum(coalesce(value, 0.0)) / 100, 6) AS score FROM events GROUP BY ALL)"
_CUES = " OR ".join(f"contains(lower(r), {sql_text(t)})" for t in N.TABLE_TAGS)
_PHRASES = " OR ".join(f"contains(lower(t), {sql_text(x)})" for x in T.NOISE_PHRASES)
_REFS = "regexp_matches(regexp_replace(t, '^\\d+(?:\\.\\d+)*\\s*', ''), '(?i)^(?:acknowledge?ments?\\s+and\\s+)?(?:references?|bibliography|works cited)(?:\\s+and\\s+.*)?$')"
_BM25 = f"""
docs AS (SELECT paper_id, {sql_ascii_tokens("concat_ws(chr(10), title, abstract, text)")} AS t FROM {_PAP}), stat AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM docs),
post AS (SELECT paper_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT paper_id, len(t) AS dl, unnest(t) AS term FROM docs) GROUP BY ALL),
freq AS (SELECT term, ln((SELECT n_docs FROM stat) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY term),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM freq) ELSE raw END AS idf FROM freq),
asked AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({sql_ascii_tokens("text")}) AS term FROM eval_items WHERE kind = 'question') GROUP BY ALL),
sc AS (SELECT item_id, paper_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM stat)))), 5) AS score FROM post JOIN asked USING (term) JOIN idf USING (term) GROUP BY ALL)"""
_SHARE = lambda c: f"coalesce(avg(CASE WHEN done THEN CASE WHEN {c} THEN 1.0 ELSE 0.0 END END), 0.0)"
_STAGE = "[" + ", ".join(map(sql_text, (*T.STAGES, "completed", "unknown"))) + "][event_id % 9 + 1]"

ORACLE = {
    "evidence_texts": f"WITH {_ROWS} SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY evidence_id) - 1 AS position, evidence_id, md5(search_text) AS text_md5 FROM rws",
    "intro_summaries": f"""WITH f AS (SELECT paper_id, text FROM {_SEC} WHERE coalesce(text, '') <> '' QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY CASE WHEN contains(lower(section_title), 'abstract') THEN 0 WHEN contains(lower(section_title), 'introduction') THEN 1 WHEN contains(lower(section_title), 'overview') THEN 2 ELSE 3 END, ordinal, section_id) = 1),
t AS (SELECT p.paper_id, coalesce(f.text, p.abstract, '') AS t FROM {_PAP} p LEFT JOIN f USING (paper_id)) SELECT paper_id, md5({_short('t', 1200)}) AS summary_md5 FROM t""",
    "encoder_views": f"SELECT paper_id, md5(trim(coalesce(title, '') || ' [SEP] ' || coalesce(abstract, ''))) AS separated_md5, md5(coalesce(title, '') || '. ' || coalesce(text, '')) AS contents_md5 FROM {_PAP}",
    "deep_chat_buckets": _BUCKETS,
    "limited_hypotheses": "SELECT topic, item_id FROM eval_items QUALIFY row_number() OVER (PARTITION BY topic ORDER BY length(text) DESC, item_id) <= 2",
    "cited_evidence": f"SELECT paper_id AS answer_id, row_number() OVER (PARTITION BY paper_id ORDER BY evidence_id DESC) AS position, evidence_id, md5({_short("coalesce(text, '')", 260)}) AS snippet_md5, NULL::VARCHAR AS html FROM {_UNI}",
    "competition_outcome": f"""WITH {_READ}, tops AS (SELECT user_id, h, avg(score) AS support FROM (SELECT * FROM rd QUALIFY row_number() OVER (PARTITION BY user_id, h ORDER BY score DESC, e) <= 3) GROUP BY ALL),
sig AS (SELECT a.user_id, a.h, any_value(a.support) AS support, any_value(a.support) - greatest(0.0, coalesce(max(b.support), 0.0)) AS margin FROM tops a LEFT JOIN tops b ON a.user_id = b.user_id AND a.h <> b.h GROUP BY a.user_id, a.h),
other AS (SELECT a.user_id, a.h, a.e, a.score, greatest(0.0, coalesce(max(b.score), 0.0)) AS o FROM rd a LEFT JOIN rd b ON a.user_id = b.user_id AND a.e = b.e AND a.h <> b.h GROUP BY ALL),
di AS (SELECT user_id, h, avg(m) AS v FROM (SELECT *, score - o AS m FROM other WHERE score > 0 AND score - o > 0.02 QUALIFY row_number() OVER (PARTITION BY user_id, h ORDER BY score - o DESC, e) <= 3) GROUP BY ALL),
co AS (SELECT user_id, h, avg(m) AS v FROM (SELECT *, o - score AS m FROM other WHERE o > 0 AND o - score > 0.02 QUALIFY row_number() OVER (PARTITION BY user_id, h ORDER BY o - score DESC, e) <= 3) GROUP BY ALL)
SELECT s.user_id, s.h AS hypothesis_id, round(support, 6) AS support, round(margin, 6) AS margin_vs_next, round(coalesce(di.v, 0.0), 6) AS discriminative_score, round(coalesce(co.v, 0.0), 6) AS conflicting_score FROM sig s LEFT JOIN di USING (user_id, h) LEFT JOIN co USING (user_id, h)""",
    "markdown_targets": f"""WITH {_SPECS}, named AS (SELECT evidence_id, unnest(object_ids) AS object_id, generate_subscripts(object_ids, 1) AS pos FROM specs),
f AS (SELECT evidence_id, arg_min('object:' || object_id, pos) AS b FROM named JOIN (SELECT object_id FROM {_OBJ} WHERE coalesce(object_type, '') <> 'equation_block') USING (object_id) GROUP BY evidence_id)
SELECT evidence_id, coalesce(b, 'section:' || s.section_id) AS block_id, 'section:' || s.section_id AS section_block_id FROM specs LEFT JOIN f USING (evidence_id) LEFT JOIN (SELECT section_id FROM {_SEC}) s USING (section_id) WHERE coalesce(b, s.section_id) IS NOT NULL""",
    "page_sizes": f"WITH {_SIZES} SELECT * FROM sizes",
    "page_rectangles": f"""WITH {_SPECS}, {_SIZES}, named AS (SELECT evidence_id, paper_id, o AS object_id, min(pos) AS pos FROM (SELECT evidence_id, paper_id, unnest(object_ids) AS o, generate_subscripts(object_ids, 1) AS pos FROM specs) GROUP BY ALL),
pl AS (SELECT n.*, x.bbox, CASE WHEN NOT EXISTS (SELECT 1 FROM sizes z WHERE z.paper_id = n.paper_id AND z.page = x.page_idx) AND EXISTS (SELECT 1 FROM sizes z WHERE z.paper_id = n.paper_id AND z.page = x.page_idx + 1) THEN x.page_idx + 1 ELSE x.page_idx END AS page
  FROM named n JOIN {_OBJ} x USING (object_id) WHERE len(x.bbox) >= 4 AND len(list_filter(x.bbox[1:4], lambda v: v IS NULL)) = 0),
g AS (SELECT evidence_id, paper_id, page, count(*)::INT AS n_boxes, arg_min(bbox[1], pos) AS first_x FROM pl WHERE page > 0 GROUP BY ALL)
SELECT evidence_id, page, width, height, n_boxes, first_x, page = min(page) OVER (PARTITION BY evidence_id) AS is_primary FROM g JOIN sizes USING (paper_id, page)""",
    "object_aliases": f"SELECT object_id, string_agg(DISTINCT evidence_id, '|' ORDER BY evidence_id) AS evidence_ids FROM (SELECT evidence_id, unnest(object_ids) AS object_id FROM {_UNI}) WHERE object_id IS NOT NULL GROUP BY object_id",
    "evidence_by_paper": f"WITH {_SPECS} SELECT paper_id, count(*)::INT AS n_specs, min(evidence_id) AS first_id, sum(len(object_ids))::INT AS n_objects FROM specs GROUP BY paper_id",
    "title_sections": f"""SELECT DISTINCT paper_id, section_id FROM (SELECT paper_id, section_id, {_key('section_title')} AS a, {_key("list_filter(coalesce(section_path, []), lambda x: trim(coalesce(x, '')) <> '')[1]")} AS b FROM {_SEC} WHERE trim(coalesce(section_id, '')) <> '')
JOIN (SELECT paper_id, {_key('title')} AS t FROM {_PAP}) USING (paper_id) WHERE t <> '' AND (a = t OR b = t)""",
    "viewer_references": f"SELECT paper_id, o, md5(r) AS text_md5 FROM (SELECT paper_id, printf('%06d', ordinal) || '-' || object_id AS o, {sql_squash("coalesce(text, '')")} AS r FROM {_OBJ}) WHERE length(r) BETWEEN 20 AND 1200 AND NOT ({_CUES}) QUALIFY row_number() OVER (PARTITION BY paper_id, lower(r) ORDER BY o) = 1",
    "compact_evidence": f"""WITH u AS (SELECT o.paper_id, object_id, o.ordinal, page_idx, {sql_squash("coalesce(section_title, '')")} AS h0, {sql_squash("coalesce(o.text, '')")} AS t, nullif({sql_squash("coalesce(caption, '')")}, '') AS c, image_path AS i FROM {_OBJ} o LEFT JOIN {_SEC} s USING (section_id) WHERE object_type <> 'equation_block'),
k AS (SELECT *, CASE WHEN h0 = '' OR regexp_replace(lower(h0), '[^a-z0-9]+', '', 'g') IN ('articleinfo', 'checkforupdates') THEN 'Paper text' ELSE h0 END AS heading FROM u),
one AS (SELECT * FROM k WHERE length(t) >= 20 OR coalesce(c, nullif(i, '')) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY paper_id, lower(heading), page_idx, lower(coalesce(nullif(t, ''), c, i, '')) ORDER BY page_idx, ordinal, object_id) = 1)
SELECT paper_id, position, object_id, heading FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY page_idx, ordinal, object_id) AS position FROM one) WHERE position <= 240""",
    "image_urls": f"SELECT object_id, CASE WHEN regexp_extract(image_path, '([^/\\\\]+)$', 1) <> '' AND NOT regexp_matches(image_path, '(^|[/\\\\])\\.\\.([/\\\\]|$)') THEN '/api/papers/' || url_encode(paper_id) || '/images/' || url_encode(regexp_extract(image_path, '([^/\\\\]+)$', 1)) END AS url FROM {_OBJ} WHERE image_path <> ''",
    "body_lines": f"""SELECT section_id, count(*) AS n_lines, sum(length(l))::BIGINT AS n_chars FROM (SELECT section_id, CASE WHEN starts_with(x, '![](') OR regexp_matches(x, '{T.CAPTION_LINE}') OR {' OR '.join(f"starts_with(x, {sql_text(o)})" for o in T.DROPPED_LINES)} THEN '' ELSE {_lines('x')} END AS l
FROM (SELECT section_id, trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS x FROM {_SEC})) WHERE l <> '' GROUP BY section_id""",
    "metadata_paragraphs": f"""SELECT object_id, x = '' OR regexp_matches(x, '{T.METADATA_LINE}') OR {' OR '.join(f"starts_with(x, {sql_text(o)})" for o in T.METADATA_OPENINGS)} OR (NOT contains(x, '.') AND ((d AND w < 40) OR (contains(x, '&') AND w < 50) OR (d AND length(x) - length(replace(x, ',', '')) >= 5))) AS is_metadata
FROM (SELECT object_id, x, regexp_matches(x, '[0-9]') AS d, len(list_filter(string_split(x, ' '), lambda y: y <> '')) AS w FROM (SELECT object_id, {_lines("coalesce(text, '')")} AS x FROM {_OBJ}))""",
    "document_titles": f"""SELECT paper_id, o, t AS title FROM (SELECT paper_id, printf('%06d', ordinal) || '-' || section_id AS o, page_start, {sql_squash("coalesce(section_title, '')")} AS t FROM {_SEC} QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY printf('%06d', ordinal) || '-' || section_id) = 1)
WHERE page_start = 1 AND NOT (t = '' OR lower(t) IN ('abstract', 'keywords') OR {_REFS} OR regexp_matches(t, '(?i)^(?:section\\s+)?\\d+(?:\\.\\d+)*\\s+') OR regexp_matches(lower(t), '^(?:appendix|appendices|acknowledg?ements?|introduction|conclusion|related work)\\b') OR {_PHRASES})""",
    "pruned_affiliations": f"""WITH a AS (SELECT DISTINCT paper_id, affiliations, list_filter(list_transform(affiliations, lambda x: {sql_squash('x')}), lambda x: coalesce(x, '') <> '') AS v FROM header_results WHERE affiliations IS NOT NULL),
x AS (SELECT paper_id, affiliations, v, unnest(v) AS s, generate_subscripts(v, 1) AS i FROM a), f AS (SELECT paper_id, affiliations, v, s, min(i) AS i FROM x GROUP BY ALL),
k AS (SELECT * FROM f WHERE len(list_filter(v, lambda y: lower(y) <> lower(s) AND contains(lower(y), lower(s)))) = 0)
SELECT DISTINCT paper_id, affiliations FROM (SELECT a.paper_id, coalesce(string_agg(s, '|' ORDER BY i), '') AS affiliations FROM a LEFT JOIN k ON a.paper_id = k.paper_id AND a.affiliations = k.affiliations GROUP BY a.paper_id, a.affiliations)""",
    "source_fields": "SELECT paper_id, concat_ws(',', " + ", ".join(f"CASE WHEN trim(coalesce({c}, '')) <> '' THEN '{c}' END" for c in ("title", "abstract", "doi", "url", "local_pdf_path", "text")) + f") AS fields FROM {_PAP}",
    "outcome_metrics": f"""WITH e AS (SELECT 'u' || user_id AS topic, event_type <> 'error' AS done, CASE WHEN second(ts) BETWEEN 1 AND 10 THEN second(ts) END AS r, CASE event_type WHEN 'purchase' THEN 'satisfied' WHEN 'click' THEN 'partial' ELSE 'no' END AS b, value AS latency FROM events)
SELECT CASE WHEN grouping(topic) = 1 THEN 'all' ELSE topic END AS topic, count(*) AS n, count(*) FILTER (done) AS n_completed, count(*) FILTER (NOT done) AS n_failed, {', '.join(f"round({_SHARE(f'r <= {k}')}, 6) AS hit_at_{k}" for k in V.CUTS)},
round(coalesce(avg(CASE WHEN done THEN coalesce(1.0 / r, 0.0) END), 0.0), 6) AS mrr, round({_SHARE("b = 'satisfied'")}, 6) AS satisfied, round({_SHARE("b IN ('satisfied', 'partial')")}, 6) AS partial_or_better, round(coalesce(avg(CASE WHEN done THEN latency END), 0.0), 6) AS avg_latency FROM e GROUP BY ROLLUP (topic)""",
    "bm25_full_ranking": f"WITH {_BM25} SELECT item_id, paper_id, coalesce(score, 0.0) AS score, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(score, 0.0) DESC, paper_id) AS rank FROM (SELECT item_id, paper_id FROM docs, eval_items WHERE kind = 'question') LEFT JOIN sc USING (item_id, paper_id)",
    "search_progress": f"SELECT event_id, {_STAGE} AS stage, round(CASE {_STAGE} WHEN 'completed' THEN 1.0 WHEN 'unknown' THEN 0.0 ELSE ((event_id % 9) + least(1.0, CASE WHEN second(ts) > 0 THEN minute(ts) / second(ts) ELSE 0.0 END)) / 7 END, 6)::DOUBLE AS progress FROM events",
    "recent_jobs": "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank <= 50",
    "grouped_blocks": f"SELECT paper_id, arg_min(caption, (page_idx, ordinal, object_id)) FILTER (trim(coalesce(caption, '')) <> '') AS title, count(*)::INT AS n_blocks, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY page_idx, ordinal, object_id)) AS texts_md5 FROM {_OBJ} GROUP BY paper_id",
    "query_slots": "SELECT item_id, slot AS query_slot, md5(q) AS text_md5 FROM (SELECT item_id, 'search_query_1' AS slot, text AS q FROM eval_items WHERE kind <> 'short_answer' UNION ALL SELECT item_id, 'search_query_2', topic FROM eval_items WHERE kind <> 'short_answer') WHERE coalesce(q, '') <> ''",
    "parse_states": f"""SELECT paper_id, CASE WHEN p THEN 'pdf_lookup' WHEN s THEN 'section_construction' WHEN o THEN 'object_construction' WHEN c THEN 'chunk_construction' ELSE 'complete' END AS stage,
CASE WHEN p THEN 'missing_local_pdf_path' WHEN s THEN 'no_sections_constructed' WHEN o THEN 'no_objects_constructed' WHEN c THEN 'no_chunks_constructed' END AS error
FROM (SELECT paper_id, trim(coalesce(local_pdf_path, '')) = '' AS p, paper_id NOT IN (SELECT paper_id FROM sections) AS s, paper_id NOT IN (SELECT paper_id FROM layout_objects) AS o, paper_id NOT IN (SELECT paper_id FROM chunks) AS c FROM {_PAP})""",
}
ORACLE["failed_papers"] = f"SELECT paper_id, title, '' AS text, 0 AS n_sections, 0 AS n_chunks, 'failed' AS parse_status, stage AS failure_stage, error AS failure_error FROM ({ORACLE['parse_states']}) JOIN {_PAP} USING (paper_id) WHERE stage <> 'complete'"
