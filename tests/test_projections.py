from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioscope.operators import planning as G
from folioscope.operators import projections as P
from folioscope.sources import store as S


def test_search_texts(spark):
    df = spark.createDataFrame([("T", None, ["H1", "H2"], " ", ["k"], {"result": 5, "error_analysis": 1})], "t string, a string, h array<string>, i string, k array<string>, c map<string,int>")
    got = df.select(P.paper_text("t", "a", "h", "i", "k", F.col("c"))).first()[0]
    assert got == "T H1 H2 k error analysis evidence result evidence result evidence result evidence"


def test_documents_and_views(spark):
    p = spark.createDataFrame([("p", "T", "A", None), ("q", "T", None, "own"), ("r", None, None, " ")], "paper_id string, title string, abstract string, text string")
    c = spark.createDataFrame([("p", 2, "c2", "two"), ("p", 1, "c1", "one")], "paper_id string, page_start int, chunk_id string, text string")
    assert {r["paper_id"]: r["document"] for r in P.paper_documents(p, c).collect()} == {"p": "T\nA\none\ntwo", "q": "T\nown", "r": ""}
    s = spark.createDataFrame([("1 Results", "x" * 50), ("References", "x" * 50), ("Intro", "short"), ("■ ABSTRACT", "x" * 60), (None, "y" * 60)], "section_title string, text string")
    assert [r["section_title"] for r in P.usable_sections(s).collect()] == ["1 Results", None]


def test_abstract_cascade(spark):
    long = " ".join(["word"] * 25)
    p = spark.createDataFrame([("a", long, "t"), ("b", "short", "t"), ("c", None, "t"), ("d", None, "t"), ("e", None, "z" * 3000), ("f", None, None)], "paper_id string, abstract string, text string")
    s = spark.createDataFrame([("b", 0, "Abstract", "the abstract"), ("c", 0, "Front", "Abstract: " + long + " Introduction more"), ("d", 1, "1 Introduction", long)], "paper_id string, ordinal int, section_title string, text string")
    got = {r["paper_id"]: (r["abstract_source"], len(r["abstract"])) for r in P.abstracts(p, s).collect()}
    assert [got[k][0] for k in "abcdef"] == ["paper_record.abstract", "section.abstract", "section.inline_abstract", "paper_record.intro_summary", "paper_record.text_prefix", "paper_record.text_prefix"]
    assert got["e"][1] == 2000 and got["f"][1] == 0


def test_orders(spark):
    ids = spark.createDataFrame([("a-10",), ("a-9",), ("a-x",), ("b-1",)], "id string")
    assert [r["id"] for r in ids.orderBy(*P.listing_order("id")).collect()] == ["a-9", "a-10", "a-x", "b-1"]
    rel = spark.createDataFrame([("acl", 2020, "all"), ("acl", 2020, "short"), ("acl", 2019, "zzz")], "venue string, year int, track string")
    assert [r["track"] for r in rel.orderBy(*P.release_order()).collect()] == ["zzz", "short", "all"]


def test_viewer_library_and_front_matter(spark):
    s = spark.createDataFrame([("p", "s1", 0, "One"), ("p", "s2", 1, "Two")], "paper_id string, section_id string, ordinal int, section_title string")
    o = spark.createDataFrame([("p", "s2", "o2", 0, "text_block", "b", 1, [0.0, 5.0, 1.0, 6.0]), ("p", "s1", "o1", 1, "text_block", "Ada Lee, Some University a@b.c", 1, [0.0, 1.0, 1.0, 2.0]), ("p", None, "o3", 0, "text_block", "z", 2, None)], "paper_id string, section_id string, object_id string, ordinal int, object_type string, text string, page_idx int, bbox array<double>")
    assert [r["ref"] for r in P.viewer_blocks(s, o).orderBy("position").collect()] == ["s1", "o1", "s2", "o2", "o3"]
    a = spark.createDataFrame([("p", "Ada  Lee"), ("p", " ")], "paper_id string, author string")
    got = P.front_matter_blocks(o, a).collect()
    assert [(r["object_id"], r["score"]) for r in got] == [("o1", 5.5)]
    papers = spark.createDataFrame([("p", " ", 2020, "acl", "text"), ("q", "T", 2021, "acl", None)], "paper_id string, title string, year int, venue string, text string")
    stats = spark.createDataFrame([("p", 3, 1)], "paper_id string, pages int, figures int")
    rows = {r["paper_id"]: (r["title"], r["status"]) for r in P.library_rows(papers, stats, spark.createDataFrame([("q",), ("p",)], "paper_id string")).collect()}
    assert rows == {"p": ("p", "ready"), "q": ("q", "failed")}


def test_author_markers(spark):
    df = spark.createDataFrame([("Ada Lee1,2*, Bo Chen2 and Cy Day",)], "x string")
    got = [(a["name"], a["markers"]) for a in df.select(P.author_markers("x")).first()[0]]
    assert got == [("Ada Lee", ["1", "2", "*"]), ("Bo Chen", ["2"]), ("Cy Day", [])]
    authors = spark.createDataFrame([("p", "A", ["1"]), ("p", "B", []), ("q", "C", []), ("q", "D", ["9"])], "paper_id string, name string, markers array<string>")
    aff = spark.createDataFrame([("p", "1", "U"), ("p", "2", "V"), ("q", "1", "W")], "paper_id string, marker string, affiliation string")
    assert {r["name"]: r["affiliations"] for r in P.affiliations_of(authors, aff, "paper_id").collect()} == {"A": ["U"], "B": [], "C": ["W"], "D": ["W"]}


def plans(spark, rows, buckets):
    return spark.createDataFrame(rows, "plan_id string, kind string, name string, query string, weight double"), spark.createDataFrame(buckets, "plan_id string, bucket_id string, description string, target int")


def test_plan_rules(spark):
    good = [("ok", "global", "g", "q", 1.0), *[("ok", "aspect", f"a{i}", "q", 2.0) for i in range(4)], ("ok", "bucket", "b", "q", 1.0)]
    bad = [("bad", "global", "g", " ", 1.0), ("bad", "aspect", "a", "q", -1.0), ("bad", "aspect", "A", "", 1.0)]
    q, b = plans(spark, good + bad, [("ok", "b", "d", 1), ("bad", "x", " ", 0), ("bad", "X ", "d", 1)])
    got = {(r["plan_id"], r["problem"]) for r in G.invalid_plans(q, b).collect()}
    assert got == {("bad", p) for p in ("aspect count", "repeated aspect", "blank aspect", "weights", "global query", "bucket without query", "bucket", "repeated bucket")}
    w = {r["name"]: r["weight"] for r in G.normalised_weights(q).where("plan_id = 'ok'").collect()}
    assert w["a0"] == pytest.approx(0.25) and w["g"] == 1.0


def test_scope_and_constraints(spark):
    df = spark.createDataFrame([(["NIPS", "acl 2021/long", ""], [2019], ["Long", "findings-demo", "x"], 'ICLR 2020 or 2019 "graph oxide" results without tin')], "v array<string>, y array<int>, t array<string>, q string")
    r = df.select(G.scope("v", "y", "t").alias("s"), G.constraints("q").alias("c")).first()
    assert r["s"].asDict() == {"venues": ["neurips", "acl"], "years": [2019, 2021], "tracks": ["long", "findings", "demo"]}
    assert r["c"]["venues"] == ["iclr"] and r["c"]["years"] == [2019, 2020] and r["c"]["phrases"] == ["graph oxide"] and r["c"]["excluded"] == ["tin"] and "experiment" in r["c"]["priors"]


def test_store(spark, tmp_path):
    st = S.KeyedStore(spark, str(tmp_path / "s"))
    one = lambda k, b: spark.createDataFrame([(k, b)], "key string, body string")
    assert st.entries("project").count() == 0
    st.save(one("a", "1"), "project")
    st.save(one("b", "1"), "project")
    st.save(one("a", "2"), "project")
    st.save(one("a", "other"), "thread")
    st.delete(one("b", None).select("key"), "project")
    assert [(r["key"], r["body"]) for r in st.entries("project").collect()] == [("a", "2")]
    st.compact(str(tmp_path / "c"))
    assert S.KeyedStore(spark, str(tmp_path / "c")).versions().count() == 2
    names = spark.createDataFrame([(1, "My Plan"), (2, "my plan!"), (3, "New")], "position int, name string")
    taken = spark.createDataFrame([("my-plan",), ("my-plan-4",)], "slug string")
    assert [r["slug"] for r in S.unique_slugs(names, taken).orderBy("position").collect()] == ["my-plan-5", "my-plan-6", "new"]


def test_traces_resume_batches_reports(spark, tmp_path):
    t = spark.createDataFrame([("t1", datetime(2024, 1, 1), "q", "body")], "trace_id string, created_at timestamp, query string, body string")
    S.save_trace(t, str(tmp_path / "old"))
    assert S.find_trace(spark, [str(tmp_path / "live"), str(tmp_path / "old")], "t1").first()["body"] == "body"
    assert S.find_trace(spark, [str(tmp_path / "none")], "t1").count() == 0
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "paper_id string")
    assert [r[0] for r in S.resume(ids("a", "b", "c"), ids("a"), ids("b")).collect()] == ["c"]
    files = spark.createDataFrame([("a", 100), ("b", 30), ("c", 10), ("d", 200)], "path string, pages int")
    assert [r["batch_no"] for r in S.batches(files, 2, 120).orderBy("path").collect()] == [0, 1, 1, 2]
    old = spark.createDataFrame([("a", 1), ("b", 1)], "paper_id string, n int")
    assert sorted((r[0], r[1]) for r in S.replace_papers(old, old.where("paper_id = 'a'").withColumn("n", F.lit(2))).collect()) == [("a", 2), ("b", 1)]
    calls = spark.createDataFrame([(1000, 500), (None, 1)], "prompt_tokens int, completion_tokens int")
    assert [r["cost"] for r in S.price(calls, 1.0, 2.0).collect()] == [pytest.approx(0.002), None]
    assert [r["cost"] for r in S.price(calls, None, 2.0).collect()] == [None, None]
    assert "| a | 0.5000 |" in S.report(spark.createDataFrame([("a", 0.5)], "k string, v double"), "R")
