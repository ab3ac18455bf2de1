import random

from folioscope.llm import leaks
from folioscope.llm.words import words


def brute(docs, items, least):
    out = set()
    for d, t in docs:
        ws = words(t)
        for i, x in items:
            iw = words(x)
            m = min(least, len(iw))
            grams = {tuple(iw[k : k + m]) for k in range(len(iw) - m + 1)} if m else set()
            if any(tuple(ws[k : k + m]) in grams for k in range(len(ws) - m + 1)):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(1)
    vocab = ["a", "b", "C", "été", "x1"]
    for least in (2, 4, 13):
        items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 20)))) for i in range(12)] + [(90, None), (91, "a, B; c")] + [(92, "a b c")]
        docs = [(d, " - ".join(rnd.choice([*vocab, "zz"]) for _ in range(rnd.randint(0, 60)))) for d in range(60)] + [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1])]
        c = spark.createDataFrame(docs, "doc_id bigint, text string").withColumnRenamed("doc_id", "doc_id").selectExpr("*", "1 AS item_id")
        i = spark.createDataFrame(items, "item_id bigint, text string")
        got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked_spans(c, i, min_words=least).collect()}
        assert got == brute(docs, items, least)


def test_spans_and_removal(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = [(1, "Before this: " + item.replace(" ", ", ") + "! After that comes more text of other words, a long row of them, and then again more."), (2, item), (3, "nothing")]
    c = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    spans = sorted((r["doc_id"], r["first_word"], r["n_words"]) for r in leaks.leaked_spans(c, i).collect())
    assert spans == [(1, 2, 20), (2, 0, 20)]
    cleaned = {r["doc_id"]: r for r in leaks.remove_leaks(c, i, max_coverage=0.6).collect()}
    assert cleaned[1]["text"].startswith("Before this: ! After") and not cleaned[1]["dropped"]
    assert cleaned[2]["dropped"] and cleaned[2]["text"] is None and 3 not in cleaned


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEM_WORDS", 5)
    items = [(k, f"alpha{k} beta{k} gamma{k}") for k in range(9)]
    c = spark.createDataFrame([(1, items[2][1] + " " + items[7][1])], "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked_spans(c, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(1, 2), (1, 7)}


def test_removal_is_the_same_in_several_passes(spark, monkeypatch):
    items = [(f"i{k}", " ".join(f"{w}{k}" for w in ("alpha", "beta", "gamma", "delta"))) for k in range(9)] + [(None, "null id here"), ("null", None)]
    rest = " and some other words beside them that stand nowhere else"
    docs = [(k % 7, f"Start: {items[k % 9][1]}, {items[(k * 2) % 9][1]}! {rest}") for k in range(20)] + [(None, items[4][1] + rest), (50, items[3][1]), (51, None), (52, ""), (53, "NULL id here" + rest)]
    c, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")
    seen = []
    for limit, together in ((400_000, 5), (5, 2), (5, 1)):
        monkeypatch.setattr(leaks, "ITEM_WORDS", limit)
        monkeypatch.setattr(leaks, "TOGETHER", together)
        spans = sorted(map(str, leaks.leaked_spans(c, i).collect()))
        seen.append((spans, sorted(map(str, leaks.remove_leaks(c, i).collect()))))
    assert seen[0] == seen[1] == seen[2] and len(seen[0][1]) == 23


def test_empty(spark):
    c = spark.createDataFrame([], "doc_id bigint, text string")
    i = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks.leaked_spans(c, i).count() == 0
    assert leaks.leaked_spans(spark.createDataFrame([(1, "a b")], c.schema), i).count() == 0


def test_removal_where_lower_case_is_longer(spark):
    item = " ".join(f"w{k}" for k in range(15))
    rest = " and other words" * 20
    docs = [(1, f"İİ in İstanbul: {item} (after){rest} İ"), (2, f"ΟΔΟΣ {item}, İw0{rest}"), (3, f"{item} İ")]
    c = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = {r["doc_id"]: (r["text"], r["dropped"]) for r in leaks.remove_leaks(c, i).collect()}
    assert got == {1: (f"İİ in İstanbul:  (after){rest} İ", False), 2: (f"ΟΔΟΣ , İw0{rest}", False), 3: (None, True)}
    for _, t in docs:
        assert [t[s:e].lower().strip("̇") for s, e in leaks.word_places(t) if t[s:e].isascii()] == [w for w, (s, e) in zip(words(t), leaks.word_places(t)) if t[s:e].isascii()]
