"""Evidence of one document for competing readings of a question: buckets, citations, competition.

Rows are evidence units (evidence_id, paper_id, evidence_type, heading, search_text), hypotheses
(hypothesis_id, paper_id, query, relation, preferred_types). A hypothesis looks only into its own paper, whose rows
bound what it meets. Empty tables give empty results; nulls count as empty texts; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions import vectors as V
from folioscope.models import Encoder, Reranker, hashed_encoder, zero_reranker
from folioscope.operators import projections as P
from folioscope.operators.ranking import EPSILON, K1, B, rank_within

CANDIDATES, GLOBAL_K, LOCAL_K, PREFERRED, RERANK = 16, 2, 5, 0.08, 0.25

#: Types a bucket may hold, and those each kind of relation prefers (fixed values).
GLOBAL_TYPES = ("section_unit", "paragraph_unit")
LOCAL_TYPES = ("paragraph_unit", "table_unit", "list_unit", "list_item_unit", "chunk_unit")
OVERVIEW = ("summary", "definition", "location")
LOCAL_PREFERENCES = {
    ("result_check", "numeric_lookup", "comparison"): ("table_unit", "list_item_unit", "paragraph_unit"),
    ("usage_check", "location"): ("paragraph_unit", "chunk_unit", "list_item_unit"),
}
OTHER_PREFERENCES = ("paragraph_unit", "chunk_unit")


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def preferred_types(relation: Column | str, own: Column | str) -> tuple[Column, Column]:
    """(types preferred globally, types preferred locally): by the relation, and locally the hypothesis' own."""
    r = F.lower(F.trim(F.coalesce(F.col(relation) if isinstance(relation, str) else relation, F.lit(""))))
    own = F.coalesce(F.col(own) if isinstance(own, str) else own, F.array().cast("array<string>"))
    broad = F.when(r.isin(*OVERVIEW), _strings(("section_unit",))).otherwise(_strings(("paragraph_unit",)))
    local = _strings(OTHER_PREFERENCES)
    # the first that names the relation counts
    for relations, types in reversed(LOCAL_PREFERENCES.items()):
        local = F.when(r.isin(*relations), _strings(types)).otherwise(local)
    return broad, F.array_union(own, local)


def runtime_rows(units: DataFrame, sections: DataFrame) -> DataFrame:
    """(paper_id, position, evidence_id, evidence_type, heading, search_text): rows of each paper, numbered from 0 by id."""
    s = sections.select("section_id", F.array_join("section_path", " ").alias("_path"), F.when(T.is_appendix("section_title", "section_path"), "appendix").otherwise("body").alias("_kind"))
    j = units.join(s, "section_id", "left")
    html = F.col("html") if "html" in units.columns else F.lit("")
    text = P.evidence_text("heading", F.col("_path"), "text", html, "evidence_type", "_kind")
    w = Window.partitionBy("paper_id").orderBy("evidence_id")
    return j.select("paper_id", (F.row_number().over(w) - 1).alias("position"), "evidence_id", "evidence_type", F.coalesce("heading", F.lit("")).alias("heading"), text.alias("search_text"))


def limit_hypotheses(hypotheses: DataFrame, by: list[str], most: int = 2) -> DataFrame:
    """The hypotheses of highest priority of each question, earlier positions on ties."""
    w = Window.partitionBy(*by).orderBy(F.desc("priority"), "position")
    return hypotheses.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def bm25_within(rows: DataFrame, by: list[str], key: str, tokens: str, query_tokens: str) -> DataFrame:
    """rows with a score: Okapi scores where every group is a collection of its own; 0 without a shared term.

    rows: (by, key, tokens, query_tokens), the query the same in a group. Only groups' own statistics are shuffled.
    """
    stats = rows.groupBy(*by).agg(F.count("*").alias("_docs"), F.avg(F.size(tokens)).alias("_avgdl"))
    df = rows.select(*by, F.explode(F.array_distinct(tokens)).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("n"))
    raw = df.join(stats, by).withColumn("raw", F.log(F.col("_docs") - F.col("n") + 0.5) - F.log(F.col("n") + 0.5))
    mean = F.avg("raw").over(Window.partitionBy(*by))
    idf = raw.withColumn("idf", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw"))).select(*by, "term", "idf", "_avgdl")
    tf = rows.select(*by, key, F.size(tokens).alias("dl"), query_tokens, F.explode(tokens).alias("term")).where(F.array_contains(query_tokens, F.col("term")))
    tf = tf.groupBy(*by, key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.first(F.size(F.filter(query_tokens, lambda x: x == F.col("term")))).alias("qf"))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("_avgdl")))
    scores = tf.join(idf, [*by, "term"]).groupBy(*by, key).agg(F.sum(part).alias("score"))
    return rows.join(scores, [*by, key], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def _selection(rows: DataFrame, encoder_sims: str, limit: int) -> DataFrame:
    """Adds fused to the preselected rows: half and half reciprocal ranks of the two top-`limit` lists, zero scores kept."""
    by = ["hypothesis_id"]
    sparse = bm25_within(rows, by, "evidence_id", "_tokens", "_query").withColumn("_s", F.round("score", 9)).drop("score")
    r = rank_within(rank_within(sparse, by, "_s", "evidence_id").withColumnRenamed("rank", "_rs"), by, encoder_sims, "evidence_id").withColumnRenamed("rank", "_rd")
    part = lambda c: F.when(F.col(c) <= limit, 0.5 / (60 + F.col(c))).otherwise(0.0)
    fused = r.withColumn("fused", part("_rs") + part("_rd")).where("fused > 0").withColumn("_f", F.round("fused", 12))
    return rank_within(fused, by, "_f", "evidence_id", limit).drop("rank", "_rs", "_rd", "_s", "_f")


def buckets(hypotheses: DataFrame, rows: DataFrame, encoder: Encoder | None = None, reranker: Reranker = zero_reranker, candidates: int = CANDIDATES, global_k: int = GLOBAL_K, local_k: int = LOCAL_K) -> DataFrame:
    """(hypothesis_id, bucket, evidence_id, evidence_type, fused, score, rank, returned) of every preselected row.

    The local bucket leaves out everything preselected globally, also what is not returned. The first k of a
    bucket are returned; all scores stay, since competition looks at them.
    """
    encoder = encoder or hashed_encoder(unit=False)
    broad, local = preferred_types("relation", "preferred_types")
    h = hypotheses.select("hypothesis_id", "paper_id", "query", broad.alias("_broad"), local.alias("_local"), T.tokens("query").alias("_query"), encoder(F.col("query")).alias("_qv"))
    r = rows.select("paper_id", "evidence_id", "evidence_type", "heading", "search_text", T.tokens("search_text").alias("_tokens"), encoder(F.col("search_text")).alias("_v"))
    met = h.join(r, "paper_id").withColumn("_sim", F.round(V.cosine("_qv", "_v"), 6)).drop("_qv", "_v")
    first = _selection(met.where(F.col("evidence_type").isin(*GLOBAL_TYPES)), "_sim", candidates)
    rest = met.where(F.col("evidence_type").isin(*LOCAL_TYPES)).join(first.select("hypothesis_id", "evidence_id"), ["hypothesis_id", "evidence_id"], "left_anti")
    second = _selection(rest, "_sim", candidates)
    cols = ["hypothesis_id", "evidence_id", "evidence_type", "heading", "search_text", "query", "fused"]
    both = first.select(*cols, F.col("_broad").alias("liked"), F.lit("global").alias("bucket"), F.lit(global_k).alias("k")).unionByName(second.select(*cols, F.col("_local").alias("liked"), F.lit("local").alias("bucket"), F.lit(local_k).alias("k")))
    score = F.col("fused") + RERANK * reranker(F.col("query"), F.concat_ws("\n", "heading", "search_text")) + F.when(F.array_contains("liked", F.col("evidence_type")), PREFERRED).otherwise(0.0)
    ranked = rank_within(both.withColumn("score", F.round(score, 12)), ["hypothesis_id", "bucket"], "score", "evidence_id")
    return ranked.select("hypothesis_id", "bucket", "evidence_id", "evidence_type", "fused", "score", "rank", (F.col("rank") <= F.col("k")).alias("returned"))


def response_evidence(answers: DataFrame, pack: DataFrame, snippet: int = 260, html: int = 1000) -> DataFrame:
    """(answer_id, position, evidence_id, page_start, page_end, snippet, html): cited units in the order of their first
    citation, only those of the answer's hypothesis.

    answers: (answer_id, hypothesis_id or null for any, used_evidence_ids); pack: (hypothesis_id, evidence_id, page_start, page_end, text, html).
    """
    cited = answers.select("answer_id", F.col("hypothesis_id").alias("_h"), F.posexplode("used_evidence_ids").alias("_pos", "evidence_id"))
    cited = cited.where(F.col("evidence_id").isNotNull()).groupBy("answer_id", "_h", "evidence_id").agg(F.min("_pos").alias("_pos"))
    hit = cited.join(pack, "evidence_id").where(F.col("_h").isNull() | (F.col("_h") == F.col("hypothesis_id")))
    w = Window.partitionBy("answer_id", "evidence_id").orderBy("hypothesis_id")
    one = hit.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    order = Window.partitionBy("answer_id").orderBy("_pos")
    short = F.nullif(T.truncate(F.coalesce("html", F.lit("")), html), F.lit(""))
    return one.select("answer_id", F.row_number().over(order).alias("position"), "evidence_id", "page_start", "page_end", T.truncate(F.coalesce("text", F.lit("")), snippet).alias("snippet"), short.alias("html"))
