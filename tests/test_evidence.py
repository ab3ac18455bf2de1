"""Evidence buckets, places in documents and parse states on small fixtures: nulls, blanks, repeats, ties, empty tables."""

import json

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import evaluation as V
from folioscope.operators import evidence as E
from folioscope.operators import navigation as N
from folioscope.operators import records as O
from folioscope.sources import markup, readers

HYP = "hypothesis_id string, paper_id string, query string, relation string, preferred_types array<string>"
ROWS = "paper_id string, evidence_id string, evidence_type string, heading string, search_text string"


def test_buckets(spark):
    kinds = ["section_unit", "paragraph_unit", "table_unit", "chunk_unit", "figure_unit"]
    rows = [("p", f"e{i:02}", kinds[i % 5], None, f"silane coupling number {i}" if i % 3 else "other words") for i in range(30)] + [("q", "x", "paragraph_unit", "", None)]
    h = [("h1", "p", "silane coupling", " Result_Check ", None), ("h2", "q", None, None, ["table_unit"]), ("h3", "nowhere", "x", "summary", [])]
    got = E.buckets(spark.createDataFrame(h, HYP), spark.createDataFrame(rows, ROWS), candidates=4).collect()
    by = {b: [r for r in got if r["hypothesis_id"] == "h1" and r["bucket"] == b] for b in ("global", "local")}
    assert {r["evidence_type"] for r in by["global"]} <= set(E.GLOBAL_TYPES) and {r["evidence_type"] for r in by["local"]} <= set(E.LOCAL_TYPES)
    assert not {r["evidence_id"] for r in by["global"]} & {r["evidence_id"] for r in by["local"]}
    assert all(len(b) <= 4 and [r["rank"] for r in sorted(b, key=lambda r: r["rank"])] == list(range(1, len(b) + 1)) for b in by.values())
    assert sum(r["returned"] for r in by["global"]) == 2 and len(by["local"]) == sum(r["returned"] for r in by["local"]) == 4
    assert [r["evidence_id"] for r in got if r["hypothesis_id"] == "h2"] == ["x"] and not [r for r in got if r["hypothesis_id"] == "h3"]
    assert E.buckets(spark.createDataFrame([], HYP), spark.createDataFrame(rows, ROWS)).count() == 0


def test_preferences_and_limits(spark):
    df = spark.createDataFrame([("location",), ("comparison",), (None,)], "r string").select(F.struct(*E.preferred_types("r", F.array(F.lit("list_unit")))).alias("x"))
    got = [tuple(map(tuple, r["x"])) for r in df.collect()]
    assert got == [(("section_unit",), ("list_unit", "paragraph_unit", "chunk_unit", "list_item_unit")), (("paragraph_unit",), ("list_unit", "table_unit", "list_item_unit", "paragraph_unit")), (("paragraph_unit",), ("list_unit", "paragraph_unit", "chunk_unit"))]
    h = spark.createDataFrame([("q", i, p) for i, p in enumerate([1.0, 3.0, None, 3.0])], "question string, position int, priority double")
    assert sorted(r["position"] for r in E.limit_hypotheses(h, ["question"]).collect()) == [1, 3]


def test_citations(spark):
    pack = spark.createDataFrame([("h1", "e1", 1, 2, "t" * 300, None), ("h1", "e2", 1, 1, None, "<table>"), ("h2", "e1", 1, 2, "t", None)], "hypothesis_id string, evidence_id string, page_start int, page_end int, text string, html string")
    answers = spark.createDataFrame([("a", "h1", ["e2", "gone", "e1", "e2", None]), ("b", None, ["e1"]), ("c", "h2", None), ("d", "h2", ["e2"])], "answer_id string, hypothesis_id string, used_evidence_ids array<string>")
    got = sorted((r["answer_id"], r["position"], r["evidence_id"], len(r["snippet"]), r["html"]) for r in E.response_evidence(answers, pack).collect())
    assert got == [("a", 1, "e2", 0, "<table>"), ("a", 2, "e1", 260, None), ("b", 1, "e1", 260, None)]


def test_places(spark):
    units = spark.createDataFrame([("p", "e1", "s1", ["o0", " o1 ", "", None, "o1"]), ("p", " e2", " ", ["nowhere"]), ("p", "e3", "s1", None), (None, "e4", "s1", [])], "paper_id string, evidence_id string, section_id string, object_ids array<string>")
    specs = N.evidence_specs(units)
    assert sorted((r["evidence_id"], r["section_id"], r["object_ids"]) for r in specs.collect()) == [("e1", "s1", ["o0", "o1", "o1"]), ("e2", None, ["nowhere"]), ("e3", "s1", [])]
    assert N.specs_by_paper(specs).first()["specs"][0]["evidence_id"] == "e1"
    sections = spark.createDataFrame([("p", "s1", "A Title!", ["x"]), ("p", "s2", None, ["", "a-title"]), ("p", "s3", "B", None)], "paper_id string, section_id string, section_title string, section_path array<string>")
    objects = spark.createDataFrame([("o0", "equation_block", 1, [0.0, 0.0, 1.0, 1.0]), ("o1", "text_block", 1, [1.0, 2.0, 3.0, 4.0]), ("o2", None, None, [1.0])], "object_id string, object_type string, page_idx int, bbox array<double>")
    got = {r["evidence_id"]: (r["block_id"], r["section_block_id"]) for r in N.markdown_targets(specs, sections, objects).collect()}
    assert got == {"e1": ("object:o1", "section:s1"), "e3": ("section:s1", "section:s1")}
    sizes = N.page_sizes(spark.createDataFrame([("p", 0, 10.0, 20.0), ("p", 1, 10.0, 0.0), ("p", None, 1.0, 1.0), ("q", 3, 5.0, 6.0)], "paper_id string, page_idx int, width double, height double"), "paper_id")
    assert sorted((r["paper_id"], r["page"]) for r in sizes.collect()) == [("p", 1), ("q", 3)]
    r = N.page_rectangles(specs, objects, sizes).collect()
    assert [(x["evidence_id"], x["page"], x["boxes"], x["is_primary"]) for x in r] == [("e1", 1, [[0.0, 0.0, 1.0, 1.0], [1.0, 2.0, 3.0, 4.0]], True)]
    papers = spark.createDataFrame([("p", "A title"), ("q", "--"), ("r", None)], "paper_id string, title string")
    assert {r["section_id"] for r in N.title_sections(sections, papers).collect()} == {"s1", "s2"}
    assert {r["object_id"]: r["evidence_ids"] for r in N.object_aliases(units).collect()}["nowhere"] == [" e2"]
    assert N.markdown_targets(specs.limit(0), sections, objects).count() == N.page_rectangles(specs.limit(0), objects, sizes).count() == 0


def test_viewer_filters(spark):
    long = "A reference that is long enough"
    refs = spark.createDataFrame([("p", 1, long), ("p", 2, long.upper()), ("p", 3, "short"), ("p", 4, None), ("p", 5, f"<TABLE> {long}"), ("p", 6, long * 60), ("q", 1, long)], "paper string, n int, raw string")
    assert sorted((r["paper"], r["n"]) for r in N.viewer_references(refs, "paper", "n", "raw").collect()) == [("p", 1), ("q", 1)]
    u = [("p", i, h, t, c, im, 1, 1) for i, (h, t, c, im) in enumerate([("Article Info", long, None, None), (None, long, None, None), ("H", "short", None, None), ("H", "", " a caption ", None), ("H", None, None, "x.png"), ("H", "", "a caption", "")])]
    got = N.compact_evidence(spark.createDataFrame(u, "paper string, n int, heading string, text string, caption string, image string, page_start int, page_end int"), "paper", ["n"]).collect()
    assert sorted((r["position"], r["n"], r["heading"]) for r in got) == [(1, 0, "Paper text"), (2, 3, "H"), (3, 4, "H")]
    df = spark.createDataFrame([("p 1", "a/b c.png"), ("p", "../x.png"), ("p", None), ("p", "a/")], "d string, p string").select(N.image_url("d", "p", "/api").alias("u"))
    assert [r["u"] for r in df.collect()] == ["/api/papers/p+1/images/b+c.png", None, None, None]


def test_text_rules(spark):
    one = lambda values, f: [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f("x")).collect()]
    assert one(["![](a)", "Figure 3 shows", "  inter-  mediate  line ", None, "Cite This: x"], T.body_line) == ["", "", "intermediate line", "", ""]
    assert one(["Received: May", "", "A, B, C, D, E, F 1", "A sentence. With 2 words", "© x", None], T.is_metadata_paragraph) == [True, True, True, False, True, True]
    assert one(["A study of silane", "Abstract", "2.1 Methods", "Introduction to x", "Proceedings of y", None, "References"], T.is_document_title) == [True, False, False, False, False, False, False]
    df = spark.createDataFrame([(["Dept X, Uni Y", "uni y", "Uni Y", None, " ", "Z"],), ([],), (None,)], "a array<string>")
    assert [r[0] for r in df.select(T.without_contained("a")).collect()] == [["Dept X, Uni Y", "Z"], [], None]
    p = spark.createDataFrame([("loading_index", 1, 2), ("saving_trace", 9, 3), ("completed", None, None), ("planning_query", 1, 0), ("x", 1, 1), (None, 1, 1)], "s string, d int, t int").select(T.overall_progress("s", "d", "t"))
    assert [round(r[0], 4) for r in p.collect()] == [0.0714, 1.0, 1.0, 0.1429, 0.0, 0.0]


def test_parse_states_and_signatures(spark):
    papers = spark.createDataFrame([(p, path, "t", ["c"]) for p, path in (("a", "x.pdf"), ("b", " "), ("c", None), ("d", "y"), ("e", "z"))], "paper_id string, local_pdf_path string, text string, chunk_ids array<string>")
    some = lambda *ids: spark.createDataFrame([(i,) for i in ids], "paper_id string")
    states = O.parse_states(papers, some("a", "a", "d", "b"), some("a", "d"), some("a"))
    assert {r["paper_id"]: r["stage"] for r in states.collect()} == {"a": "complete", "b": "pdf_lookup", "c": "pdf_lookup", "d": "chunk_construction", "e": "section_construction"}
    failed = {r["paper_id"]: r for r in O.failed_papers(papers, states).collect()}
    assert set(failed) == {"b", "c", "d", "e"} and failed["d"]["text"] == "" and failed["d"]["chunk_ids"] == [] and failed["d"]["failure_error"] == "no_chunks_constructed"
    files = spark.createDataFrame([("x.pdf", 5, "2024-01-01")], "path string, length bigint, t string").select("path", "length", F.to_timestamp("t").alias("modificationTime"))
    sign = lambda f: {r["paper_id"]: r["signature"] for r in O.build_signature(["paper_id", "text"], "local_pdf_path", f)(papers).collect()}
    one, two = sign(files), sign(files.withColumn("length", F.lit(6)))
    assert one["a"] != two["a"] and one["b"] == two["b"] and len(set(one.values())) == 5
    blocks = spark.createDataFrame([("p", 2, "b", None), ("p", 1, None, " "), ("p", 3, "c", "T")], "doc string, n int, text string, title string")
    g = O.grouped_blocks(blocks, "doc", ["n"], "text", "title").first()
    assert g["texts"] == ["", "b", "c"] and g["title"] == "T"


def test_outcomes(spark):
    df = spark.createDataFrame([("t", "completed", 1, "satisfied", 2.0), ("t", "completed", None, "partial", None), ("t", "failed", 1, "satisfied", 9.0), (None, "failed", None, None, None)], "topic string, job_status string, target_rank int, target_bucket string, latency double")
    got = {r["topic"]: r for r in V.outcome_metrics(df).collect()}
    assert (got["all"]["n"], got["all"]["n_completed"], got["all"]["n_failed"]) == (4, 2, 2)
    assert (got["t"]["hit_at_1"], got["t"]["mrr"], got["t"]["satisfied"], got["t"]["partial_or_better"], got["t"]["avg_latency"]) == (0.5, 0.5, 0.5, 1.0, 2.0)
    assert got["none"]["mrr"] == got["none"]["avg_latency"] == 0.0


def test_layout_parts(spark):
    block = {"lines": [{"spans": [{"latex": "x^2"}, {"value": " y "}]}], "image_caption": [{"text": "Fig 1"}], "bbox": [1, 2, 3, 4, 5], "type": "Text"}
    supplement = {"img_path": "a/b.png", "table_html": "<table><tr><td>1</td><td>2</td></tr></table>", "table_footnote": "note"}
    df = spark.createDataFrame([(json.dumps(block), json.dumps(supplement), "image"), (None, json.dumps(supplement), "table"), ("bad", None, "table")], "b string, s string, k string")
    got = [r["p"].asDict() for r in df.select(markup.layout_parts("b", "s", "k").alias("p")).collect()]
    assert got[0] == {"caption": "Fig 1", "footnote": "", "html": supplement["table_html"], "body": "1 2", "math": "x^2 y", "image": "a/b.png"}
    assert (got[1]["footnote"], got[1]["body"], got[2]["body"], got[2]["image"]) == ("note", "1 2", "", None)
    doc = json.dumps({"pdf_info": [{"page_idx": 0, "para_blocks": [block, {"type": "header", "text": "x"}, {"type": "title", "text": "T", "bbox": [1]}]}]})
    rows = readers.layout_blocks(spark.createDataFrame([("p", doc)], "paper_id string, json string")).collect()
    assert [(r["block_type"], r["text"], r["bbox"], r["page_idx"]) for r in sorted(rows, key=lambda r: r["ordinal"])] == [("text", "x^2 y", [1.0, 2.0, 3.0, 4.0], 1), ("title", "T", [], 1)]
