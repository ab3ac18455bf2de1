import math

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import evaluation as E
from folioscope.operators import qa as QA
from folioscope.operators import ranking as R
from folioscope.operators import selection as L


def okapi(docs, query, k1=1.5, b=0.75):
    n = len(docs)
    avg = sum(map(len, docs.values())) / n
    df = {}
    for ws in docs.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else floor for w, v in raw.items()}
    return {k: sum(idf[w] * ws.count(w) * (k1 + 1) / (ws.count(w) + k1 * (1 - b + b * len(ws) / avg)) for w in query if w in ws) for k, ws in docs.items() if set(ws) & set(query)}


def test_bm25_with_negative_idf_and_repeated_query_terms(spark):
    docs = {1: "gold gold silver".split(), 2: "gold tin".split(), 3: "gold lead lead lead".split(), 4: []}
    df = spark.createDataFrame([(k, " ".join(v), "x") for k, v in docs.items()] , "doc bigint, text string, term string")
    q = spark.createDataFrame([(9, "gold lead gold"), (8, ""), (7, "absent")], "q bigint, text string")
    got = {(r["q"], r["doc"]): r["score"] for r in R.bm25(df, "doc", T.ascii_tokens("text"), q, "q", T.ascii_tokens("text")).collect()}
    want = {(9, k): v for k, v in okapi(docs, ["gold", "lead", "gold"]).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_empty_collection(spark):
    df = spark.createDataFrame([], "doc bigint, text string")
    assert R.bm25(df, "doc", T.ascii_tokens("text"), df.withColumnRenamed("doc", "q"), "q", T.ascii_tokens("text")).count() == 0


def test_normalise_degenerate_groups(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 0.0), ("c", -1.0), ("d", 1.0), ("d", 3.0), ("d", 2.0)], "g string, s double")
    got = sorted((r["g"], r["normalised"]) for r in R.normalise(df, ["g"], "s").collect())
    assert got == [("a", 1.0), ("a", 1.0), ("b", 0.0), ("c", 0.0), ("d", 0.0), ("d", 0.5), ("d", 1.0)]


def test_ties_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), "id", (F.col("id") % 7).cast("double").alias("s"))
    one = R.rank_within(df.repartition(7, "id"), ["g"], "s", "id", 50).orderBy("rank").collect()
    two = R.rank_within(df.repartition(3, "s"), ["g"], "s", "id", 50).orderBy("rank").collect()
    assert one == two and [r["id"] for r in one[:3]] == [6, 13, 20]


def test_fusion(spark):
    df = spark.createDataFrame([("x", "a", 1, None), ("x", "b", 2, "p2"), ("y", "a", 2, "p9"), ("y", "c", 1, None)], "r string, id string, rank int, passage string")
    got = {r["id"]: (r["score"], r["passage"]) for r in R.rrf_with_passage(df, [], "id", "r", "passage").collect()}
    assert got["a"] == (pytest.approx(1 / 61 + 1 / 62), "p9") and got["b"][1] == "p2" and got["c"][1] is None
    w = {r["id"]: r["score"] for r in R.weighted_rrf(df, [], "id", F.when(F.col("r") == "x", 0.7).otherwise(0.3)).collect()}
    assert w["a"] == pytest.approx(0.7 / 61 + 0.3 / 62)
    s = spark.createDataFrame([("k", 1.0), ("l", 2.0)], "k string, score double")
    t = spark.createDataFrame([("l", 4.0), ("m", 1.0)], "k string, score double")
    assert {r["k"]: r["score"] for r in R.mix(s, t, ["k"], 0.5, 0.25).collect()} == {"k": 0.5, "l": 2.0, "m": 0.25}


def test_blend_and_passages(spark):
    df = spark.createDataFrame([("p", "c1", 1.0), ("p", "c2", 3.0), ("p", "c3", 2.0), ("p", "c4", 0.5), ("q", "d1", 1.0)], "p string, c string, s double")
    got = {r["p"]: r["score"] for r in R.blend_top3(df, ["p"], "s", "c").collect()}
    assert got == {"p": pytest.approx(0.7 * 3 + 0.2 * 2 + 0.1), "q": pytest.approx(0.7)}
    scores = df.select(F.lit("z").alias("q1"), "c", F.col("s").alias("score"))
    best = R.best_passage(df.select("c", "p"), scores, spark.createDataFrame([("p",), ("q",), ("none",)], "p string"), "q1", "c", "p", spark.createDataFrame([("z",)], "q1 string"))
    assert {r["p"]: (r["score"], r["c"]) for r in best.collect()} == {"p": (3.0, "c2"), "q": (1.0, "d1"), "none": (float("-inf"), None)}


def test_scope_after_the_cut(spark):
    ranked = R.rank_within(spark.range(10).select(F.lit(1).alias("g"), "id", (-F.col("id")).alias("s")), ["g"], "s", "id")
    allowed = spark.createDataFrame([(4,), (8,)], "id bigint")
    assert [r["id"] for r in R.post_limit_scope(ranked, allowed, "id", 5).collect()] == [4]


def test_phrase_hits(spark):
    chunks = spark.createDataFrame([("p", "c1", "Cross-Coupling of tin"), ("p", "c2", "tin"), ("q", "c3", "tinny")], "paper string, chunk_id string, text string")
    terms = spark.createDataFrame([("z", "cross coupling"), ("z", "TIN"), ("z", "tin"), ("z", "the")], "plan string, term string")
    got = {r["paper"]: r["score"] for r in R.phrase_hits(chunks, "paper", F.col("text"), terms, "plan", "term").collect()}
    assert got == {"p": pytest.approx(2.1)}


def test_verdicts_and_display(spark):
    df = spark.createDataFrame([("q", f"p{i}", v, s) for i, (v, s) in enumerate([("satisfied", 0.9), ("satisfied", 0.9), ("partial", 1.0), ("rejected", 2.0), ("satisfied", 0.1)])], "plan_id string, paper_id string, verdict string, final_score double")
    shown = L.display_fill(L.verdict_top(df, ["plan_id"], "final_score", "paper_id", 2), ["plan_id"], 3).orderBy("display_rank").collect()
    assert [r["paper_id"] for r in shown] == ["p0", "p1", "p2"]


def test_metrics(spark):
    ranks = spark.createDataFrame([("q1", "t", 1), ("q2", "t", 4), ("q3", "u", None)], "query_id string, topic string, target_rank int")
    got = {r["topic"]: r for r in E.metrics(ranks).collect()}
    assert got["all"]["mrr"] == pytest.approx(1.25 / 3) and got["t"]["hit_at_3"] == 0.5 and got["u"]["hit_at_10"] == 0 and got["all"]["n"] == 3
    votes = spark.createDataFrame([("a", True), ("a", False), ("b", False), ("b", None)], "k string, v boolean")
    assert {r["k"]: r["accepted"] for r in E.majority(votes, ["k"], "v").collect()} == {"a": True, "b": False}


def test_competition(spark):
    rows = [("q", "h1", "e1", 0.9), ("q", "h2", "e1", 0.5), ("q", "h3", "e1", 0.7), ("q", "h1", "e2", 0.1), ("q", "h2", "e2", 0.11), ("q", "h1", "e3", 0.4)]
    s = spark.createDataFrame(rows, "question string, hypothesis_id string, evidence_id string, score double")
    d = {(r["hypothesis_id"], r["evidence_id"]): r["margin"] for r in QA.competition_evidence(s, "question", "discriminative", 5).collect()}
    assert d == {("h1", "e1"): pytest.approx(0.2), ("h1", "e3"): pytest.approx(0.4)}
    c = {(r["hypothesis_id"], r["evidence_id"]): r["other_id"] for r in QA.competition_evidence(s, "question", "conflicting", 5).collect()}
    assert c == {("h2", "e1"): "h1", ("h3", "e1"): "h1"}
    sig = {r["hypothesis_id"]: r for r in QA.competition_signal(s, "question").collect()}
    assert sig["h1"]["strongest_competitor"] == "h3" and sig["h3"]["margin_vs_next"] == pytest.approx(0.7 - (0.9 + 0.1 + 0.4) / 3)


def test_grounding_and_decisions(spark):
    pack = spark.createDataFrame([("h1", "e1")], "hypothesis_id string, evidence_id string")
    cited = spark.createDataFrame([("h1", "e1"), ("h1", "e2")], pack.schema)
    assert [r["evidence_id"] for r in QA.ungrounded(cited, pack).collect()] == ["e2"]
    facts = spark.createDataFrame([("h1", "f1"), ("h3", "f1"), ("h3", "f2")], "hypothesis_id string, fact_list string")
    assert sorted(r[0] for r in QA.uncovered(spark.createDataFrame([("h1",), ("h2",), ("h3",)], "hypothesis_id string"), facts).collect()) == ["h2", "h3"]
    v = spark.createDataFrame([("clear", "no_clear_winner", "supported", "aligned"), ("clear", "clear_winner", "unsupported", "aligned"), ("clear", "weak_winner", "supported", "aligned"), ("clear", "clear_winner", "supported", "aligned")], "interpretation_verdict string, competition_verdict string, support_verdict string, alignment_verdict string")
    assert [r["decision"] for r in QA.decide(v).collect()] == ["ask_clarification", "unsupported", "answer_with_note", "answer"]
