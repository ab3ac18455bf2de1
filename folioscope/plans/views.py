"""Views, payloads, plans and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import planning as G
from folioscope.operators import projections as P
from folioscope.operators import records as O
from folioscope.plans.common import sql_squash, table
from folioscope.sources import store as S


def _papers(s: SparkSession, d: str) -> DataFrame:
    return O.latest(table(s, d, "papers").select("paper_id", "title", "abstract", "text", "venue", "year", "keywords", "authors", "ingested_at"), "paper_id", "ingested_at")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return O.latest(table(s, d, "chunks").select("chunk_id", "paper_id", "heading", "text", "page_start", "ingested_at"), "chunk_id", "ingested_at")


def _sections(s: SparkSession, d: str) -> DataFrame:
    return O.latest(table(s, d, "sections").select("section_id", "paper_id", "section_title", "section_path", "ordinal", "text", "ingested_at"), "section_id", "ingested_at")


def paper_documents(s: SparkSession, d: str) -> DataFrame:
    return P.paper_documents(_papers(s, d), _chunks(s, d)).select("paper_id", F.md5("document").alias("document_md5"))


def labelled_views(s: SparkSession, d: str) -> DataFrame:
    j = _chunks(s, d).select("chunk_id", "paper_id", "heading", "text").join(_papers(s, d).select("paper_id", "title", "abstract"), "paper_id")
    return j.select("chunk_id", F.md5(P.labelled_view("title", "abstract", "heading", "text")).alias("view_md5"))


def usable_sections(s: SparkSession, d: str) -> DataFrame:
    return P.usable_sections(_sections(s, d)).select("section_id", P.heading_form("section_title").alias("heading"))


def benchmark_passages(s: SparkSession, d: str) -> DataFrame:
    return P.benchmark_passages(_chunks(s, d), table(s, d, "papers")).select("paper_id", "passage_id", "passage_rank", F.md5("passage_text").alias("text_md5"))


def abstract_sources(s: SparkSession, d: str) -> DataFrame:
    return P.abstracts(_papers(s, d), _sections(s, d)).groupBy("abstract_source").agg(F.count("*").alias("n"), F.sum(F.length("abstract")).alias("n_chars"))


def viewer_blocks(s: SparkSession, d: str) -> DataFrame:
    o = O.latest(table(s, d, "layout_objects").select("object_id", "paper_id", "section_id", "ordinal", "object_type", "text", "ingested_at"), "object_id", "ingested_at")
    return P.viewer_blocks(_sections(s, d), o).select("paper_id", "position", "kind", "ref")


def library_rows(s: SparkSession, d: str) -> DataFrame:
    stats = O.paper_statistics(O.latest(table(s, d, "layout_objects"), "object_id", "ingested_at"))
    return P.library_rows(_papers(s, d), stats, table(s, d, "papers").where("text IS NULL").select("paper_id").distinct())


def front_matter(s: SparkSession, d: str) -> DataFrame:
    """Blocks of first pages that name authors, mail addresses or institutions."""
    a = _papers(s, d).select("paper_id", F.explode("authors").alias("author"))
    return P.front_matter_blocks(O.latest(table(s, d, "layout_objects"), "object_id", "ingested_at"), a)


def listing_positions(s: SparkSession, d: str) -> DataFrame:
    """Papers of a corpus in listing order."""
    from pyspark.sql import Window

    p = table(s, d, "papers").where("anthology_id IS NOT NULL").select("paper_id", "corpus_key", F.col("anthology_id").alias("a")).distinct()
    return p.withColumn("position", F.row_number().over(Window.partitionBy("corpus_key").orderBy(*P.listing_order("a"), "paper_id"))).select("corpus_key", "paper_id", "position")


def question_constraints(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "eval_items").select("item_id", G.constraints(F.concat(F.lit("ACL or NIPS 2021, no demo: "), F.col("text"))).alias("c"))
    return x.select("item_id", F.array_join("c.venues", ",").alias("venues"), F.array_join(F.transform("c.years", lambda y: y.cast("string")), ",").alias("years"), F.array_join("c.tracks", ",").alias("tracks"), F.array_join("c.priors", ",").alias("priors"))


def author_lines(s: SparkSession, d: str) -> DataFrame:
    """Names and markers of author lines made of each paper's authors."""
    line = F.array_join(F.transform(F.filter("authors", lambda a: F.trim(a) != ""), T.squash), " and ")
    x = _papers(s, d).where("authors IS NOT NULL").select("paper_id", F.posexplode(P.author_markers(line)).alias("pos", "a"))
    return x.select("paper_id", "pos", F.col("a.name").alias("name"), F.size("a.markers").alias("n_markers"))


def resume_queue(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers")
    return S.resume(p.select("paper_id").distinct(), table(s, d, "header_results").select("paper_id"), p.where("text IS NULL").select("paper_id"))


def published_papers(s: SparkSession, d: str) -> DataFrame:
    """Papers with those of the last year replaced by their short form."""
    p = _papers(s, d).select("paper_id", "title", "year")
    return S.replace_papers(p, p.where("year >= 2023").withColumn("title", F.upper("title")))


def search_texts(s: SparkSession, d: str) -> DataFrame:
    p = _papers(s, d).select("paper_id", F.md5(P.joined("title", "abstract", F.array_join("keywords", " "))).alias("text_md5"))
    return p


QUERIES = {
    f.__name__: f
    for f in (paper_documents, labelled_views, usable_sections, benchmark_passages, abstract_sources, viewer_blocks, library_rows, front_matter, listing_positions, question_constraints, author_lines, resume_queue, published_papers, search_texts)
}

_PAP = "(SELECT * FROM papers QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at DESC) = 1)"
_SEC = "(SELECT * FROM sections QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY ingested_at DESC) = 1)"
_CHK = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1)"
_OBJ = "(SELECT * FROM layout_objects QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY ingested_at DESC) = 1)"
_TEXT = sql_squash("coalesce(text, '')")
_OWN_TEXT = "CASE WHEN trim(coalesce(text, '')) <> '' THEN trim(text) ELSE passages END"
_KEYS = "array_to_string(keywords, ' ')"
_LINE, _BLANK = "chr(10)", "' '"


def _form(c: str) -> str:
    return "upper(" + sql_squash(f"regexp_replace({c}, '^[\\s#■▪•*]*(?:\\d+(?:\\.\\d+)*\\.?\\s+)?', '')") + ")"

_HEADS = ", ".join(f"'{h}'" for h in P.SKIP_HEADINGS)
_STOPS = " OR ".join(f"starts_with(h, '{h}')" for h in P.STOP_HEADINGS)
_BOTH = ", ".join(f"'{h}'" for h in P.SKIP_HEADINGS + P.STOP_HEADINGS)


def _join(sep: str, *parts: str) -> str:
    return f"array_to_string(list_filter([{', '.join(f"coalesce({p}, '')" for p in parts)}], lambda x: trim(x) <> ''), {sep})"


_LABEL = lambda n, c: f"CASE WHEN trim(coalesce({c}, '')) <> '' THEN '{n}: ' || trim({c}) END"

ORACLE = {
    "labelled_views": f"SELECT chunk_id, md5({_join('chr(10) || chr(10)', _LABEL('Title', 'p.title'), _LABEL('Abstract', 'p.abstract'), _LABEL('Heading', 'c.heading'), 'c.text')}) AS view_md5 FROM {_CHK} c JOIN {_PAP} p USING (paper_id)",
    "front_matter": f"""WITH o AS (SELECT paper_id, object_id, lower({_TEXT}) AS t, coalesce(bbox[2], 0.0) AS y, coalesce(bbox[1], 0.0) AS x FROM {_OBJ} WHERE page_idx = 1 AND length({_TEXT}) > 0),
a AS (SELECT DISTINCT paper_id, lower({sql_squash('u')}) AS a FROM (SELECT paper_id, unnest(authors) AS u FROM {_PAP}) WHERE {sql_squash('u')} <> ''),
n AS (SELECT paper_id, object_id, count(*) AS names FROM o JOIN a USING (paper_id) WHERE contains(t, a) GROUP BY ALL),
sc AS (SELECT *, (CASE WHEN coalesce(names, 0) > 0 THEN 3.0 ELSE 0.0 END + CASE WHEN contains(t, '@') THEN 1.5 ELSE 0.0 END + CASE WHEN regexp_matches(t, 'universit|institute|department|laborator|school|academy|college|centre|center') THEN 1.0 ELSE 0.0 END - CASE WHEN length(t) > 600 THEN 2.0 ELSE 0.0 END)::DOUBLE AS score FROM o LEFT JOIN n USING (paper_id, object_id))
SELECT paper_id, object_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY y, x, score DESC, object_id)::INT AS rank FROM sc WHERE score > 0) WHERE rank <= 8""",
    "paper_documents": f"SELECT paper_id, md5({_join(_LINE, 'title', 'abstract', _OWN_TEXT)}) AS document_md5 FROM {_PAP} LEFT JOIN (SELECT paper_id, string_agg(text, chr(10) ORDER BY page_start, chunk_id) AS passages FROM {_CHK} GROUP BY paper_id) USING (paper_id)",
    "usable_sections": f"SELECT section_id, h AS heading FROM (SELECT section_id, text, {_form('section_title')} AS h FROM {_SEC}) WHERE coalesce(NOT (h IN ({_HEADS}) OR {_STOPS}), true) AND length({_TEXT}) >= 40",
    "benchmark_passages": f"SELECT paper_id, chunk_id AS passage_id, row_number() OVER (PARTITION BY paper_id ORDER BY page_start, chunk_id) AS passage_rank, md5({_join(_LINE, 'heading', 'text')}) AS text_md5 FROM (SELECT *, {_form('heading')} AS h FROM {_CHK}) WHERE length({_TEXT}) >= 80 AND coalesce(h NOT IN ({_BOTH}), true) AND paper_id IN (SELECT paper_id FROM papers)",
    "viewer_blocks": f"""SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY s, o, ref) AS position, kind, ref FROM (SELECT paper_id, ordinal AS s, -1 AS o, 'heading' AS kind, section_id AS ref FROM {_SEC}
UNION ALL SELECT x.paper_id, coalesce(y.ordinal, 1 << 30), x.ordinal, x.object_type, x.object_id FROM {_OBJ} x LEFT JOIN {_SEC} y ON x.section_id = y.section_id)""",
    "library_rows": f"""WITH st AS (SELECT paper_id, max(page_idx) AS pages, count(*) FILTER (object_type = 'figure_block') AS figures FROM {_OBJ} GROUP BY paper_id), ready AS (SELECT * FROM {_PAP} WHERE text IS NOT NULL)
SELECT paper_id, coalesce(nullif({sql_squash('title')}, ''), paper_id) AS title, year, upper(venue) AS venue, pages, figures, 'ready' AS status FROM ready LEFT JOIN st USING (paper_id)
UNION ALL SELECT DISTINCT paper_id, paper_id, NULL, NULL, NULL, NULL, 'failed' FROM papers WHERE text IS NULL AND paper_id NOT IN (SELECT paper_id FROM ready)""",
    "listing_positions": "SELECT corpus_key, paper_id, row_number() OVER (PARTITION BY corpus_key ORDER BY regexp_replace(a, '[^.-]*$', ''), try_cast(regexp_extract(a, '([^.-]*)$', 1) AS BIGINT) IS NULL, try_cast(regexp_extract(a, '([^.-]*)$', 1) AS BIGINT), a, paper_id) AS position FROM (SELECT DISTINCT corpus_key, paper_id, anthology_id AS a FROM papers WHERE anthology_id IS NOT NULL)",
    "resume_queue": "SELECT DISTINCT paper_id FROM papers WHERE paper_id NOT IN (SELECT paper_id FROM header_results) AND paper_id NOT IN (SELECT paper_id FROM papers WHERE text IS NULL)",
    "published_papers": f"SELECT paper_id, CASE WHEN year >= 2023 THEN upper(title) ELSE title END AS title, year FROM {_PAP}",
    "search_texts": f"SELECT paper_id, md5({_join(_BLANK, 'title', 'abstract', _KEYS)}) AS text_md5 FROM {_PAP}",
}
