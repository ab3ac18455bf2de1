import pytest
from pyspark.sql import functions as F

from folioscope.models import overlap_reranker
from folioscope.operators import search as S

PAPERS = [
    ("p1", "k/2020/long", "Widget benchmark", "We present the widget benchmark for silane coupling"),
    ("p2", "k/2020/long", "Widget system", "Our widget system searches catalysts"),
    ("p3", "k/2021/long", "Polymer brushes", "A study of polymer brushes under argon"),
    ("p4", "k/2021/short", "Electrode wear", "Electrode wear after many cycles"),
    ("p5", "k/2021/short", "Unrelated", ""),
]
SECTIONS = [
    ("s11", "p1", "Benchmark", "The widget benchmark evaluates silane coupling with three metrics"),
    ("s12", "p1", "Results", "Results on the widget benchmark improve accuracy"),
    ("s21", "p2", "System", "The widget system ranks catalysts"),
    ("s31", "p3", "Brushes", "Polymer brushes grow under argon"),
    ("s41", "p4", "Wear", "Electrodes wear in cycles"),
]


@pytest.fixture(scope="module")
def index(spark):
    t = "2024-01-01 00:00:00"
    p = spark.createDataFrame([(i, k, ti, a, ["x"], t) for i, k, ti, a in PAPERS], "paper_id string, corpus_key string, title string, abstract string, keywords array<string>, at string").withColumn("ingested_at", F.to_timestamp("at"))
    s = spark.createDataFrame([(i, q, h, [h], x, t) for i, q, h, x in SECTIONS], "section_id string, paper_id string, section_title string, section_path array<string>, text string, at string").withColumn("ingested_at", F.to_timestamp("at"))
    c = spark.createDataFrame([("c" + i, i, q, "text_chunk", h, x, t) for i, q, h, x in SECTIONS], "chunk_id string, section_id string, paper_id string, chunk_type string, heading string, text string, at string").withColumn("ingested_at", F.to_timestamp("at"))
    return S.make_index(p, s, c)


def plan(spark, queries, terms=(), buckets=()):
    return S.Plan(
        spark.createDataFrame(list(queries), "plan_id string, kind string, name string, query string, weight double"),
        spark.createDataFrame(list(terms), "plan_id string, kind string, term string"),
        spark.createDataFrame(list(buckets), "plan_id string, bucket_id string, description string, target int"),
    )


def full(spark):
    q = [("q", "global", "g", " widget benchmark for silane coupling ", 1.0), ("q", "aspect", "a1", "widget benchmark metrics", 0.6), ("q", "aspect", "a2", "silane coupling", 0.4)]
    q += [("q", "bucket", "b1", "widget benchmark results", 1.0), ("q", "bucket", "b2", "silane coupling", 1.0), ("q", "bucket", "b2", " ", 1.0)]
    q += [("none", "global", "g", "zzz qqq", 1.0)]
    return plan(spark, q, [("q", "entity", "Widget-Benchmark"), ("q", "phrase", "three metrics"), ("q", "phrase", "the")], [("q", "b1", "evaluation result", 2), ("q", "b2", "chemistry", 1), ("none", "b1", "x", 1)])


def test_target_paper_comes_first(spark, index):
    got = S.search(full(spark), index, index.papers.select("paper_id"), S.Models(reranker=overlap_reranker)).collect()
    first = min((r for r in got if r["plan_id"] == "q" and r["verdict"] == "satisfied"), key=lambda r: r["verdict_rank"])
    assert first["paper_id"] == "p1"
    assert len({(r["plan_id"], r["paper_id"]) for r in got}) == len(got)


def test_stages(spark, index):
    models, p = S.Models(), full(spark)
    allowed = index.papers.where("corpus_key LIKE 'k/2020%'").select("paper_id")
    pool = S.candidates(p, index, allowed, models)
    rows = {(r["plan_id"], r["paper_id"]): r["coarse"] for r in pool.collect()}
    assert {k for k in rows if k[0] == "q"} == {("q", "p1"), ("q", "p2")} and rows["q", "p1"] > rows["q", "p2"]
    narrowed = S.narrow_sections(p, index, pool, models)
    n = {(r["plan_id"], r["section_id"]): r["score"] for r in narrowed.collect()}
    assert n["q", "s11"] == max(v for k, v in n.items() if k[0] == "q") and all(v > 0 for v in n.values())
    ev = S.assemble_evidence(p, index, narrowed, models).collect()
    got = {b: sorted(r["chunk_id"] for r in ev if r["bucket_id"] == b and r["paper_id"] == "p1") for b in ("b1", "b2")}
    # of two chunks the lower one normalises to 0 and is dropped, as min-max over a paper's own rows has it
    assert got["b1"] == ["cs12"] and len(got["b2"]) == 1 and all(0 <= r["score"] <= 1 for r in ev)
    short = S.shortlist(p, pool, narrowed, S.assemble_evidence(p, index, narrowed, models), 1).collect()
    assert {r["paper_id"] for r in short if r["plan_id"] == "q"} == {"p1"}


def test_profiles(spark, index):
    allowed = index.papers.select("paper_id")
    for profile in ("no_planner", "no_verifier", "no_content_refinement"):
        got = S.search(full(spark), index, allowed, profile=profile).where("plan_id = 'q'").collect()
        assert min(got, key=lambda r: (r["verdict"] != "satisfied", r["verdict_rank"]))["paper_id"] == "p1", profile
        if profile == "no_verifier":
            assert {r["verdict"] for r in got} == {"satisfied"}


def test_scope_is_applied_after_the_cut(spark, index, monkeypatch):
    monkeypatch.setattr(S, "SOURCE_LIMIT", 1)
    q = plan(spark, [("q", "global", "g", "widget", 1.0)])
    allowed = index.papers.where("paper_id = 'p2'").select("paper_id")
    after = {r["paper_id"] for r in S.candidates(q, index, allowed, S.Models()).collect()}
    before = {r["paper_id"] for r in S.candidates(q, index, allowed, S.Models(), scope_pushdown=True).collect()}
    assert before == {"p2"} and after <= {"p2"}


def test_no_signal_no_results(spark, index):
    q = plan(spark, [("q", "global", "g", "", 1.0)])
    assert S.search(q, index, index.papers.select("paper_id")).count() == 0
    empty = S.Index(index.papers.limit(0), index.sections.limit(0), index.chunks.limit(0))
    assert S.search(full(spark), empty, index.papers.select("paper_id")).count() == 0
