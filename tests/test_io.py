import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioscope import config
from folioscope.schema import EVENTS, PAPER
from folioscope.sources import readers as R
from folioscope.sources import sinks as S
from folioscope.streaming import jobs

T0 = datetime(2024, 1, 1)


def test_json_lines_modes(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"k": "a", "n": 1}\n\n{"k": "b", "n": "bad"}\nnot json\n')
    schema = "k string, n int"
    assert [r["k"] for r in R.json_lines(spark, str(p), schema, "DROPMALFORMED").collect()] == ["a"]
    assert R.json_lines(spark, str(p), schema, "PERMISSIVE").where("k IS NOT NULL").count() == 2
    with pytest.raises(Exception):
        R.json_lines(spark, str(p), schema).collect()
    missing = R.json_lines(spark, str(tmp_path / "none.jsonl"), PAPER)
    assert missing.count() == 0 and "paper_id" in missing.columns
    (tmp_path / "state.json").write_text('{\n"k": "a",\n"n": 2}')
    assert R.json_document(spark, str(tmp_path / "state.json"), schema).first()["n"] == 2
    assert R.json_document(spark, str(tmp_path / "no.json"), schema).count() == 0


def test_precedence_and_lookup(spark):
    raw = spark.createDataFrame([("a", "raw"), ("b", "raw")], "id string, v string")
    norm = spark.createDataFrame([("a", "norm")], "id string, v string")
    assert {r["id"]: r["v"] for r in R.with_precedence(raw, norm, "id").collect()} == {"a": "norm", "b": "raw"}
    assert R.lookup(raw, norm, "id", "a").first()["v"] == "norm" and R.lookup(raw, norm, "id", "b").first()["v"] == "raw" and R.lookup(raw, norm, "id", "z").count() == 0


def test_listings_and_titles(spark):
    html = '<a href="/2023.acl-long.0/">Front</a><a class=x href="/2023.acl-long.1/">A <b>title</b></a><a href="/2023.acl-long.1/">Last title</a><a href="/2023.acl-long.2/"> </a>'
    got = R.listings(spark.createDataFrame([("u", html), ("v", None)], "url string, html string")).collect()
    assert [(r["listing_id"], r["title"]) for r in got] == [("2023.acl-long.1", "Last title")]


def test_header_tei(spark):
    ok = '<?xml version="1.0"?><TEI xmlns="http://x"><teiHeader><fileDesc><titleStmt><title>A  title</title></titleStmt></fileDesc><author><persName><surname>Doe</surname></persName><affiliation><orgName type="institution">U</orgName></affiliation></author></teiHeader></TEI>'
    got = {r["path"]: r for r in R.header_tei(spark.createDataFrame([("a", ok), ("b", "<TEI><bad"), ("c", None)], "path string, xml string")).collect()}
    assert got["a"]["title"] == "A title" and got["a"]["affiliations"] == ["U"] and got["a"]["surnames"] == ["Doe"]
    assert got["b"]["title"] is None and got["c"]["title"] is None


def test_pdf_files_and_uploads(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "my_paper-v2.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "copy.PDF").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "fake.pdf").write_bytes(b"hello")
    assert R.pdf_files(spark, str(tmp_path)).count() == 3 and R.pdf_files(spark, str(tmp_path / "no")).count() == 0
    up = R.pdf_uploads(spark, str(tmp_path)).collect()
    assert len(up) == 1 and up[0]["paper_id"].startswith("personal-") and up[0]["title"] in ("my paper v2", "copy")


def test_id_list(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("b # note\n\n# only\na\nb\r\nc")
    assert [(r["position"], r["id"]) for r in R.id_list(spark, str(tmp_path / "ids.txt")).orderBy("position").collect()] == [(1, "b"), (2, "a"), (3, "c")]


def test_catalogue_releases_failures(spark):
    m = spark.createDataFrame([("acl/2020/long", "b"), ("broken", "b"), ("a/b/c", "b")], "corpus_key string, build_id string")
    assert [(r["venue"], r["year"]) for r in R.catalogue(m).collect()] == [("acl", 2020)]
    st = spark.createDataFrame([("k", "completed"), ("l", "completed"), ("m", "running")], "corpus_key string, status string")
    files = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "b"), ("l", "a"), ("m", "a"), ("m", "b")], "corpus_key string, name string")
    assert [r["corpus_key"] for r in R.completed_releases(st, ["a", "b"], files).collect()] == ["k"]
    f = spark.createDataFrame([("p", "parse", "E1", "m", T0), ("p", "parse", "E2", "m", T0 + timedelta(1)), ("q", "x", "E", "m", T0)], "paper_id string, stage string, error_type string, error_message string, failed_at timestamp")
    assert [(r["paper_id"], r["error_type"]) for r in R.open_failures(f, spark.createDataFrame([("q",)], "paper_id string")).collect()] == [("p", "E2")]


def test_benchmarks(spark):
    raw = spark.createDataFrame([(1, " q  x ", ["a", "b"]), (2, "", ["c"]), (3, "y", None)], "id int, question string, paper_ids array<string>")
    assert sorted(r["target"] for r in R.paper_search_benchmark(raw).collect()) == ["a", "b"]
    qa = spark.createDataFrame([("q1", "p", "why", ["a"], None)], "query_id string, paper_id string, question string, answers array<string>, evidence array<string>")
    extra = spark.createDataFrame([("q1", "b"), ("q1", "a"), ("q1", " ")], "query_id string, answer string")
    r = R.review_qa_benchmark(qa, extra).first()
    assert sorted(r["gold_answers"]) == ["a", "b"] and r["gold_evidence"] == []
    doc = json.dumps({"qas": [{"question_id": "x", "question": "Q?", "answers": [{"answer": {"unanswerable": False, "free_form_answer": "", "extractive_spans": ["s1", "s2"], "yes_no": None}}, {"answer": {"unanswerable": True}}]}]})
    got = [(r["answer"], r["answerable"]) for r in R.nested_qa_benchmark(spark.createDataFrame([("p", doc)], "paper_id string, json string")).orderBy("answer_no").collect()]
    assert got == [("s1 s2", True), (None, False)]


def test_layout_and_markdown(spark):
    doc = json.dumps({"pdf_info": [{"page_idx": 0, "para_blocks": [{"type": "Title", "text": "T", "bbox": [0, 0, 1, 1]}, {"type": "page number", "text": "1"}]}, {"page_idx": 1, "para_blocks": [{"type": "text", "text": " a  b "}]}]})
    got = [(r["ordinal"], r["page_idx"], r["block_type"], r["text"]) for r in R.layout_blocks(spark.createDataFrame([("p", doc)], "paper_id string, json string")).orderBy("ordinal").collect()]
    assert got == [(0, 1, "title", "T"), (1, 2, "text", "a b")]
    md = "pre\n# One\na\n\nb\n## 2 Two ##\nc\n# References\n[1]\n# After\nz"
    rows = [(r["section_no"], r["level"], r["heading"], r["text"]) for r in R.markdown_sections(spark.createDataFrame([("d", md)], "k string, m string"), "k", "m").orderBy("section_no").collect()]
    assert rows == [(0, 0, None, "pre"), (1, 1, "One", "a\n\nb"), (2, 2, "2 Two", "c")]


def test_publish_and_current(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("a", 1)], "id string, n int")
    assert S.read_current(spark, root, "k", "id string, n int").count() == 0
    S.publish(spark, df, root, "k", "b1")
    S.publish(spark, df.union(df), root, "k", "b2")
    with pytest.raises(ValueError):
        S.publish(spark, df.limit(0), root, "k", "b3")
    assert S.read_current(spark, root, "k", "id string, n int").count() == 2
    assert [r["build_id"] for r in S.current_builds(spark, root).collect()] == ["b2"]


def test_resumable_encoding(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    vec = F.array(F.lit(1.0).cast("float"))
    path = str(tmp_path / "v")
    assert S.encode_resumable(spark, df.limit(1), "id", vec, path) == 1
    assert S.encode_resumable(spark, df, "id", vec, path) == 1
    assert S.encode_resumable(spark, df, "id", vec, path) == 0
    assert spark.read.parquet(path).count() == 2


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([("k", "a", 1), ("k", "b", None), ("l", "c", 2)], "k string, s string, n int")
    one = S.fingerprint(df.repartition(3), ["k"], ["s", "n"]).orderBy("k").collect()
    assert one == S.fingerprint(df.orderBy(F.desc("s")), ["k"], ["s", "n"]).orderBy("k").collect()
    two = S.fingerprint(df.withColumn("n", F.coalesce("n", F.lit(0))), ["k"], ["s", "n"]).orderBy("k").collect()
    assert one[0] != two[0] and one[1] == two[1]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("p1", "A {B} title", ["X Y", " ", "Z"], "acl", 2020, None, "http://u", None)], "paper_id string, title string, authors array<string>, venue string, year int, doi string, url string, abstract string")
    bib = S.bibtex(df).first()["value"]
    assert "author = {X Y and Z}" in bib and "booktitle = {ACL}" in bib and r"A \{B\} title" in bib and "doi" not in bib and "abstract" not in bib
    ris = S.ris(df).first()["value"].split("\n")
    assert ris[0] == "TY  - CONF" and ris[-1] == "ER  - " and ris.count("AU  - Z") == 1
    S.write_tsv(df.select("paper_id", "year"), str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).first()["year"] == "2020"
    S.write_records(spark.createDataFrame([("x", f"i{i}") for i in range(50)], "corpus_key string, id string"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).where("corpus_key = 'x'").count() == 50
    paths = spark.createDataFrame([("old/a.png",), ("other/b.png",)], "p string")
    assert [r[0] for r in paths.select(S.rebase_paths("p", "old/", "new/")).collect()] == ["new/a.png", "other/b.png"]


def test_feedback(spark):
    rows = [("up", "t", None, None), ("down", "t", "q", "why"), ("down", "t", "q", " "), ("side", "t", "q", "r"), ("up", "t" * 300, "q", None), (None, "t", None, None)]
    ok, bad = S.feedback(spark.createDataFrame(rows, "vote string, target string, query string, reason string"))
    assert ok.count() == 2 and bad.count() == 4


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text("top_k = 7\nunknown = 1\ncandidate_pool = 30\n")
    s = config.load(str(tmp_path / "c.toml"), {"FOLIOSCOPE_TOP_K": "9"})
    assert (s.top_k, s.candidate_pool, s.chunk_target_tokens) == (9, 30, 420)


def events(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def test_stream_runs_equal_batch_and_resume(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    one = events(spark, [(1, T0, 1, "view", 1.0, "{}"), (2, T0 + timedelta(hours=1), 2, "click", 2.0, "{}"), (2, T0, 2, "click", 2.0, "{}")])
    one.toPandas().astype({"ts": "datetime64[us]"}).to_parquet(src / "events-1.parquet")
    jobs.ingest(jobs.event_stream(spark, str(src)), "event_id", out, cp)
    assert spark.read.parquet(out).count() == 2
    two = events(spark, [(2, T0, 2, "click", 2.0, "{}"), (3, T0 + timedelta(hours=2), 1, "error", None, "{}")])
    two.toPandas().astype({"ts": "datetime64[us]"}).to_parquet(src / "events-2.parquet")
    for _ in range(2):
        jobs.ingest(jobs.event_stream(spark, str(src)), "event_id", out, cp)
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    live = jobs.drain(jobs.latest_state(jobs.event_stream(spark, str(src))), "latest_states", "complete", str(tmp_path / "cp2"))
    assert {r["user_id"]: r["last_type"] for r in live.collect()} == {1: "error", 2: "click"}


def test_retention_forgets_jobs(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, (user, at) in enumerate([(1, T0), (2, T0 + timedelta(hours=2)), (2, T0 + timedelta(hours=4))]):
        events(spark, [(i, at, user, "view", 1.0, "{}")]).toPandas().astype({"ts": "datetime64[us]"}).to_parquet(src / f"events-{i}.parquet")
    got = jobs.drain(jobs.retained(jobs.event_stream(spark, str(src), 1)), "held_jobs", "append", str(tmp_path / "cp")).collect()
    assert (1, True) in {(r["job"], r["expired"]) for r in got} and len([r for r in got if not r["expired"]]) == 3


def test_activity_and_sessions(spark):
    e = events(spark, [(1, T0, 1, "view", 1.0, "{}"), (2, T0 + timedelta(minutes=10), 1, "view", None, None), (3, T0 + timedelta(hours=2), 1, "view", 2.0, "{}")])
    assert sorted((r["n"], r["total"]) for r in jobs.activity(e).collect()) == [(1, 2.0), (2, 1.0)]
    assert sorted(r["n"] for r in jobs.sessions(e).collect()) == [1, 2]
