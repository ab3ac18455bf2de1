import random
from datetime import datetime

from folioscope.llm import neardup
from folioscope.llm.graph import components

SCHEMA = "paper_id string, title string, abstract string, text string, ingested_at timestamp"
T = datetime(2024, 1, 1)


def jaccard(a, b, n):
    a, b = (set(neardup.shingle_set(list(x), n).tolist()) for x in (a, b))
    return len(a & b) / len(a | b) if a | b else 0


def test_pairs_against_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"w{k}" for k in range(500)]
    base = [[rnd.choice(vocab) for _ in range(200)] for _ in range(30)]
    rows = []
    for i, b in enumerate(base):
        rows.append((f"p{i}", "t", None, " ".join(b), T))
        for j in range(4):
            c = list(b)
            for _ in range(rnd.choice([1, 5, 10, 20])):
                c[rnd.randrange(len(c))] = rnd.choice(vocab)
            rows.append((f"p{i}v{j}", "t", "", " ".join(c), T))
        rows.append((f"p{i}c", "T", None, " ".join(b).upper(), T))
    rows += [("short", None, None, "two words", T), ("null", None, None, None, T), ("p0", "t", None, rows[0][3], T)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS f0")
    got = {tuple(r) for r in neardup.expand_pairs(neardup.near_duplicates(df, "paper_id", ["title", "abstract", "text"], "ingested_at", 3, 0.6)).collect()}
    by = {r[0]: r[1:4] for r in rows}
    ids = sorted(by)
    want = {(a, b) for a in ids for b in ids if a < b and jaccard(by[a], by[b], 3) >= 0.6}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_copies_are_one_class_and_hot_buckets_are_salted(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    text = " ".join(f"w{k}" for k in range(300))
    rows = [(f"a{i}", "t", None, text, T) for i in range(40)] + [(f"b{i:02}", "t", None, text + f" extra{i} tail{i}", T) for i in range(25)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), "paper_id", ["title", "abstract", "text"], "ingested_at")
    assert found.members.select("class_id").distinct().count() == 26
    assert found.links.count() == 26 * 25 // 2
    assert {r["component"] for r in components(found.links, "class_a", "class_b").collect()} == {"a0"}
    pairs = [tuple(r) for r in neardup.expand_pairs(found).collect()]
    assert len(pairs) == len(set(pairs)) == 65 * 64 // 2 and all(a < b for a, b in pairs)


def test_latest_version_counts(spark):
    later = datetime(2024, 2, 1)
    text = " ".join(f"w{k}" for k in range(80))
    other = " ".join(f"v{k}" for k in range(80))
    rows = [("a", None, None, text, T), ("b", None, None, text + " x", T), ("emptied", None, None, text, T), ("emptied", None, None, None, later), ("moved", None, None, text, T), ("moved", None, None, other, later), ("c", None, None, other + " y", None)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), "paper_id", ["title", "abstract", "text"], "ingested_at", 3, 0.6)
    assert {r["id"] for r in found.members.collect()} == {"a", "b", "moved", "c"}
    assert sorted(map(tuple, neardup.expand_pairs(found).collect())) == [("a", "b"), ("c", "moved")]


def test_empty(spark):
    found = neardup.near_duplicates(spark.createDataFrame([], SCHEMA), "paper_id", ["title"], "ingested_at")
    assert found.members.count() == found.links.count() == neardup.expand_pairs(found).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}") for k in range(60)] + [("x", "y")], "a string, b string")
    got = {r["id"]: r["component"] for r in components(links, "a", "b").collect()}
    assert {got[f"n{k:03}"] for k in range(61)} == {"n000"} and got["y"] == "x"
