import random
from datetime import datetime

from folioscope.llm import scans

T = datetime(2024, 1, 1)
GOOD = "The mesoporous silica retained most of its selectivity after seventeen cycles in methanol and the reaction followed a known pathway"
PAPERS = "paper_id string, title string, text string, authors array<string>, ingested_at timestamp"


def wrap(*lines):
    return "\n".join(lines)


def make(spark, noisy):
    rnd = random.Random(1)
    ws = GOOD.split()
    clean = [(f"c{i}", f"Title number {i}", " ".join(rnd.sample(ws, len(ws))) + ". A metal-organic frame and the retro-aldol step.", None, T) for i in range(60)]
    rows = clean + [(f"n{i}", title, text, None, T) for i, (title, text) in enumerate(noisy)]
    papers = spark.createDataFrame(rows, PAPERS)
    objects = spark.createDataFrame([(f"o{i}", f"n{i}", t, T, 1) for i, (_, t) in enumerate(noisy)] * 2 + [("oz", None, None, T, 1), ("oe", "n0", "", T, 1), (None, "n0", "x", T, 1)], "object_id string, paper_id string, text string, ingested_at timestamp, kind int")
    sections = spark.createDataFrame([], "section_id string, paper_id string, text string")
    records = scans.scan_records(objects, sections, papers)
    return scans.Scan(records, papers), records


NOISY = [
    ("A", wrap("The mesoporous silica retained most of its selec-", "tivity after seventeen cycles in methanol.")),
    ("B", wrap("A metal-", "organic frame and the retro-", "aldol step. Short-, medium-", "and long tests.")),
    ("C", "The mes0porous silica retainecl most of its selectivity."),
    ("Controlling the reaction of methanol in silica", wrap("The mesoporous silica retained most of its", "Controlling the reaction of", "selectivity after seventeen cycles.")),
    ("E", wrap("The mesoporous silica retained most of its", "- 123 -", "selectivity after seventeen cycles in metha¬", "833   Vizenith et al.", "nol.")),
    ("F", wrap("KK-518", "158", "15.92", "XK-909", "65", "6.77")),
    ("G", wrap("The reaction followed a known pathway", "CHEMLIB 2023", "322", "and the silica retained selectivity.", "", "            p. 216", "", "1. The silica.", "2. The methanol.")),
    ("H", wrap("The mesoporous silica", "Chemlib Letters, Vol. 33, No. 12", "retained selectivity.", "506   SOLVDATA 2018")),
]


def test_kinds(spark):
    scan, _ = make(spark, NOISY)
    rows = [(r["record_table"], r["record_id"], r["kind"]) for r in scan.kinds().collect()]
    assert len(rows) == len(set(rows))
    got = {k: {kind for t, i, kind in rows if (t, i) == ("layout_objects", k)} for k in (f"o{i}" for i in range(len(NOISY)))}
    assert got == {
        "o0": {"hyphen"},
        "o1": set(),
        "o2": {"chars"},
        "o3": {"header"},
        "o4": {"hyphen", "header", "page_number"},
        "o5": set(),
        "o6": {"header", "page_number"},
        "o7": {"header", "page_number"},
    }
    assert {k for t, i, k in rows if (t, i) == ("papers", "n4")} == got["o4"]
    assert not [r for r in rows if r[1].startswith("c") or r[1] in ("oz", "oe")]


def test_repair(spark):
    scan, records = make(spark, NOISY)
    text = {r["record_id"]: r["text"] for r in scan.repaired(records).collect() if r["record_table"] == "layout_objects"}
    assert text["o0"] == "The mesoporous silica retained most of its selectivity after seventeen cycles in methanol."
    assert text["o1"] == "A metal-organic frame and the retro-aldol step. Short-, medium- and long tests."
    assert text["o2"] == "The mesoporous silica retained most of its selectivity."
    assert text["o3"] == "The mesoporous silica retained most of its selectivity after seventeen cycles."
    assert text["o4"] == "The mesoporous silica retained most of its selectivity after seventeen cycles in methanol."
    assert text["o5"] == NOISY[5][1]
    assert text["o6"].split("\n\n")[0] == "The reaction followed a known pathway and the silica retained selectivity."
    assert "1. The silica.\n2. The methanol." in text["o6"] and "216" not in text["o6"]


def test_anagram_join_against_substitution(spark):
    rnd = random.Random(3)
    good = ["".join(rnd.choice("acdehilmnorstuw") for _ in range(8)) for _ in range(200)]
    rows = {w: 50 for w in good}
    want = {}
    for w in good:
        for bad, right in scans.CONFUSIONS[:12]:
            if right in w and sum(c.isalpha() for c in w.replace(right, bad, 1)) >= 3:
                m = w.replace(right, bad, 1)
                if m not in rows or rows[m] == 1:
                    rows[m] = 1
                    want.setdefault(m, set()).add(w)
    df = spark.createDataFrame(list(rows.items()), "word string, df bigint")
    got = {r["word"]: r["variant"] for r in scans.corrections(df).collect()}
    assert set(got) >= set(want)
    assert all(got[m] in good for m in want)


def test_empty(spark):
    papers = spark.createDataFrame([], PAPERS)
    none = spark.createDataFrame([], "object_id string, section_id string, paper_id string, text string")
    records = scans.scan_records(none, none, papers)
    scan = scans.Scan(records, papers)
    assert scan.kinds().count() == 0 and scan.repaired(records).count() == 0


def test_copies_and_frequent_errors(spark):
    rnd = random.Random(5)
    ws = GOOD.split()
    clean = [(f"c{i}", None, " ".join(rnd.sample(ws, len(ws))) + ".", None, T) for i in range(150)]
    noisy = " ".join(rnd.sample(ws, len(ws))).replace("selectivity", "se1ectivity").replace("reaction", "rcaction")
    alike = [(f"e{i}", None, noisy, None, T) for i in range(30)] + [(f"f{i}", None, noisy + f" Appendix {i}.", None, T) for i in range(30)]
    versions = [("v", None, " ".join(rnd.sample(ws, len(ws))).replace("pathway", "pathvvay") + f" Draft {i}.", None, T) for i in range(40)]
    often = [(f"o{i}", None, " ".join(rnd.sample(ws, len(ws))).replace("mesoporous", "rnesoporous"), None, T) for i in range(6)]
    papers = spark.createDataFrame(clean + alike + versions + often + [("x", None, None, None, T)], PAPERS)
    none = spark.createDataFrame([], "object_id string, section_id string, paper_id string, text string")
    scan = scans.Scan(scans.scan_records(none, none, papers), papers)
    df = {r["word"]: r["df"] for r in scan.evidence.collect()}
    assert (df["se1ectivity"], df["pathvvay"], df["rnesoporous"], df["silica"]) == (1, 1, 6, 150 + 1 + 1 + 6)
    assert df["rnesoporous"] >= scans.FEW
    assert {r["record_id"] for r in scan.kinds().collect() if r["kind"] == "chars"} == {r[0] for r in alike + versions + often}
    assert {r["word"]: r["variant"] for r in scan.fixes.collect()} == {"se1ectivity": "selectivity", "rcaction": "reaction", "pathvvay": "pathway", "rnesoporous": "mesoporous"}


def test_no_caps_on_lines(spark):
    long = "silica " * 30
    title = "On the retention of selectivity " * 5 + "in silica"
    noisy = [
        (title, wrap(long + "selec-", *[""] * 12, "tivity after cycles.", title, "and the reaction followed.")),
        ("R", wrap(*[x for i in range(4) for x in ("The mesoporous silica retained most of its selectivity.", f"Notes on catalysis {30 + i}", "After seventeen cycles the reaction followed.")])),
        ("S", wrap("The mesoporous silica retained most of its", "Journal of the long name of a society that prints " + "very " * 12 + "much, Vol. 12", "- 123456 -", "selectivity.")),
    ]
    scan, records = make(spark, noisy)
    rows = {(r["record_id"], r["kind"]) for r in scan.kinds().collect() if r["record_table"] == "layout_objects"}
    assert rows == {("o0", "hyphen"), ("o0", "header"), ("o1", "header"), ("o1", "page_number"), ("o2", "header"), ("o2", "page_number")}
    text = {r["record_id"]: r["text"] for r in scan.repaired(records).collect()}
    assert "selectivity after cycles." in text["o0"] and "Notes on catalysis" not in text["o1"]


def test_a_real_word_stays(spark):
    rows = {"clear": 500, "dear": 60, "modern": 900, "modem": 4, "rnodern": 30}
    df = spark.createDataFrame(list(rows.items()), "word string, df bigint")
    assert {r["word"]: r["variant"] for r in scans.corrections(df).collect()} == {"modem": "modern", "rnodern": "modern"}
