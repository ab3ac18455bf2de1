import hashlib
import math
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions import vectors as V
from folioscope.sources import markup


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select(expr.alias("y"), "i").orderBy("i").collect()]


def test_tokens_and_null(spark):
    texts = ["The C-H activation, of α-lactam: in  35 % yield!", "", None, "a an the", "naïve É_x", "x" * 100000]
    plain = str.maketrans({c: " " for c in string.punctuation})
    want = [[w for w in (t or "").lower().translate(plain).split() if w not in T.STOPWORDS] for t in texts]
    assert col(spark, texts, T.tokens("x")) == want
    assert col(spark, texts[:5], T.ascii_tokens("x")) == [re.findall("[a-z0-9]+", (t or "").lower()) for t in texts[:5]]


def test_phrase_containment_is_whole_token(spark):
    df = spark.createDataFrame([("cross-coupling of silane", "cross coupling"), ("crosscouplings", "cross"), ("x", ""), ("of the", "of")], "h string, n string")
    got = [r[0] for r in df.select(T.contains_phrase(T.match_text("h"), T.match_text("n"))).collect()]
    assert got == [True, False, False, False]


def test_truncate_squash_slug_levels(spark):
    assert col(spark, ["short", "a" * 30, "word  " * 10, None], T.truncate("x", 20)) == ["short", "a" * 17 + "...", ("word  " * 10)[:17].rstrip() + "...", None]
    assert col(spark, [" a \n\t b ", None, ""], T.squash("x")) == ["a b", None, ""]
    heads = ["1 Intro", "2.3.1 Deep", "Section 4.2 X", "1.2.3.4.5 Y", "Appendix A", "A. Lemma", "Results", ""]
    assert col(spark, heads, T.heading_level("x")) == [1, 3, 2, 4, 1, 2, 1, 1]
    refs = ["References", "7 REFERENCES", "Acknowledgements and References", "Bibliography and notes", "Works cited", "Reference data", "Preferences"]
    assert col(spark, refs, T.is_reference_heading("x")) == [True, True, True, True, True, False, False]
    assert col(spark, ["Hello, World!", "---", "é"], T.slug("x")) == ["hello-world", "item", "item"]


def test_stable_id(spark):
    want = "chunk_" + hashlib.sha1(b"p:7:").hexdigest()[:16]
    df = spark.createDataFrame([("p", 7, None)], "a string, b int, c string")
    assert df.select(T.stable_id("chunk", "a", "b", "c")).first()[0] == want


def test_references(spark):
    md = "# Intro\ntext\n\n## References\n\n[1] A. Author. A long title about silanes. 2019a. doi:10.1000/xyz.12,\n\n[2] B. Author, no year here but continued\n\nin the next block, 2021. arXiv:2101.01234v2 https://x.example/a).\n\nshort\n\n# Appendix\nmore 2020 text that is long enough"
    entries = col(spark, [md, "no references", None], T.reference_entries("x"))
    assert len(entries[0]) == 2 and "continued in the next block" in entries[0][1] and entries[1] == []
    e = entries[0]
    assert col(spark, e, T.reference_year("x")) == [2019, 2021]
    assert col(spark, e, T.reference_doi("x")) == ["10.1000/xyz.12", None]
    assert col(spark, e, T.reference_arxiv("x")) == [None, "2101.01234"]
    assert col(spark, e, T.reference_url("x")) == [None, "https://x.example/a"]


def test_lists_reasons_durations(spark):
    assert col(spark, ["- one - two", "1. a b 2. c d", "x; y; z", "plain", None], T.list_items("x")) == [["- one", "- two"], ["1. a b", "2. c d"], ["x", "y", "z"], [], []]
    assert col(spark, ["A b. C d! A b. E?", "", None], T.main_reason("x")) == ["A b.", None, None]
    assert col(spark, ["A b. C d! a B. E? F."], T.matching_points("x")) == [["C d!", "E?"]]
    assert col(spark, [3723.0, 65.0, 3.4, -1.0, None], T.duration("x"), "double") == ["1h 02m 03s", "1m 05s", "3s", "-", "-"]


def test_evidence_scores(spark):
    df = spark.createDataFrame([("Results", ["Paper", "Results"], "accuracy and f1 in the table improves"), ("Appendix A", None, None), ("Intro", [], "nothing")], "h string, p array<string>, t string")
    got = [r[0] for r in df.select(T.evidence_scores("h", F.array_join("p", " "), "t")).collect()]
    assert got[0]["result"] == 1.0 and got[1]["appendix"] == 0.9 and got[2] == {}
    kinds = [r[0] for r in df.select(T.evidence_types(T.evidence_scores("h", F.array_join("p", " "), "t"))).collect()]
    assert kinds[0][0] == "result" and kinds[2] == []


def test_priors_tracks_html(spark):
    assert col(spark, ["Compare training of methods", ""], T.section_priors("x")) == [["method", "training", "baseline"], []]
    assert col(spark, ["2023.acl-long", "main", "short", None, "Demo"], T.track_of("x")) == ["long", "long", "short", "unknown", "demo"]
    assert col(spark, ["<p>a&amp;b</p><script>x</script> c", None], T.html_text("x")) == ["a&b c", None]
    page = '<title>T</title><meta property="og:title" content="O"><meta name="citation_title" content="C &lt;x&gt;">'
    assert col(spark, [page, "<title> T </title>", "<p>"], T.page_title("x")) == ["C <x>", "T", None]
    assert col(spark, ["hydro-\ngen and well-Known", "soft­ware"], T.dehyphenate("x")) == ["hydrogen and well-Known", "software"]


def test_html_tables(spark):
    html = "<table><tr><th rowspan=2>A</th><th colspan=2>B</th></tr><tr><td>1</td><td>2<br>3</td></tr></table>"
    cells = [(c["row"], c["col"], c["header"], c["text"]) for c in col(spark, [html, None, "x"], markup.html_table("x"))[0]]
    assert cells == [(0, 0, True, "A"), (0, 1, True, "B"), (1, 1, False, "1"), (1, 2, False, "2 3")]


def test_nested_text_and_answers(spark):
    assert col(spark, ['{"lines": [{"spans": [{"content": " a "}, {"content": "b"}]}]}', "bad", None], markup.nested_text("x")) == ["a b", "", ""]
    got = col(spark, ['<think>{"a": 1}</think> ok ```json\n{"b": {"c": [2]}} tail```', "none { here", None], markup.json_answer("x"))
    assert got == ['{"b": {"c": [2]}}', None, None]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.cosine("a", "b")).collect()]
    assert got[0] == pytest.approx(0.96) and got[1] == 0 and got[2] is None
    s = col(spark, [[1.0, 2.0], []], V.softmax("x"), "array<double>")
    assert s[0] == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)]) and s[1] == []
    boxes = spark.createDataFrame([(["0", "0", "2", "2"],), (["a", "0", "1", "1"],), ([],)], "b array<string>")
    assert [r[0] for r in boxes.select(V.box("b")).collect()] == [[0, 0, 2, 2], [], []]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_truncate_never_exceeds(spark, texts):
    texts = [t.replace("\x00", "") for t in texts]
    assert all(len(t) <= 12 for t in col(spark, texts, T.truncate("x", 12)))
