import random

import numpy as np
import pytest

from folioscope.llm import mojibake as mb

EN = ["The sample was dried at {n} °C under argon, giving k = {n} ± 0.5 s⁻¹.", "Samples cost €{n} per batch… the “résumé” lists a naïve façade team.", "The λ maximum shifted to {n} nm – a 5.1 Å distance.", "Plain words only, number {n}."]
RU = ["Выход продукта составил {n} процентов, примеси не обнаружены.", "Раствор фильтровали, осадок промывали и сушили до постоянной массы {n} г."]
ZH = ["催化剂经过{n}次循环后活性略有下降。", "将样品过滤并干燥,测得含量为{n}毫克。"]
JA = ["この触媒を用いて反応を{n}時間行い、収率で生成物を得た。", "試料の測定値は{n}であり、再現性は良好であった。"]
DE = ["Die Lösung wurde über Nacht bei {n} °C gerührt und anschließend gewaschen. ÄÖÜ sind GROẞ.", "Größere Mengen führten zu Rückständen."]
PT = ["A AVALIAÇÃO DA ÁGUA residual indicou {n} mg por fração. SÍNTESE E CARACTERIZAÇÃO: a reação não mudou."]


def wrong(text, right, read):
    out = []
    for b in text.encode(right):
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(0)
    clean = [rnd.choice(rnd.choice([EN, EN, EN, RU, ZH, JA, DE, PT])).format(n=rnd.randint(1, 99)) for _ in range(3000)]
    bad = [
        ("utf-8", "cp1252", EN[0]), ("utf-8", "latin-1", EN[2]), ("utf-8", "cp1252", DE[0]), ("utf-8", "cp1252", RU[0]), ("utf-8", "cp1251", RU[1]),
        ("utf-8", "mac_roman", EN[0]), ("utf-8", "cp437", DE[1]), ("utf-8", "latin-1", ZH[0]), ("utf-8", "latin-1", JA[0]),
        ("cp1251", "latin-1", RU[0]), ("koi8_r", "latin-1", RU[1]), ("gb18030", "latin-1", ZH[1]), ("cp932", "cp1252", JA[1]),
    ]
    pairs = [(t, wrong(t, right, read)) for right, read, t in ((a, b, t.format(n=7)) for a, b, t in bad)]
    twice = DE[0].format(n=3)
    pairs.append((twice, wrong(wrong(twice, "utf-8", "cp1252"), "utf-8", "cp1252")))
    rows = list(enumerate(clean)) + [(10_000 + i, "Some plain lead.\n" + b) for i, (_, b) in enumerate(pairs)]
    rows += [(20_000, None), (20_001, ""), (20_002, "dried at 7 �C"), (20_003, "café &eacute; \\u00e9"), (20_004, "a\x85b"), (10_000, "Some plain lead.\n" + pairs[0][1])]
    return pairs, spark.createDataFrame(rows, "doc_id bigint, text string")


def test_found_and_restored(corpus):
    pairs, df = corpus
    rows = mb.garbled_texts(df.selectExpr("*", "true AS lost")).collect()
    got = {r["doc_id"]: r for r in rows}
    assert set(got) == {10_000 + i for i in range(len(pairs))} | {20_002}
    assert len(rows) == len(got) + 1  # a repeated row repeats
    assert got[20_002]["lost"] and not got[20_002]["n_restored"]
    right = [got[10_000 + i]["text"] == "Some plain lead.\n" + t for i, (t, _) in enumerate(pairs)]
    assert sum(right) >= len(pairs) - 1, [p for p, ok in zip(pairs, right) if not ok]


def test_nothing_clean_and_empty(spark):
    df = spark.createDataFrame([(1, "über façade — Å"), (2, None)], "doc_id bigint, text string")
    assert mb.garbled_texts(df).count() == 0
    assert mb.garbled_texts(df.limit(0)).count() == 0


def test_candidates_round_trip():
    for run in ("é", "–", "°", "λ", "₂"):
        for g in mb.garble(run):
            assert run in mb.run_candidates(g)
    assert mb.run_candidates("ÇÃ") == {} and mb.as_utf8("Ã©–", "cp1252") == "é–"
    assert mb.stretches("é" * 5 + "\nabc\nxéééy z\n") == [(0, 5), (10, 17)]


def test_single_byte_charsets_read_in_another(spark):
    rnd = random.Random(2)
    clean = [rnd.choice([*EN, *RU, *RU, *ZH]).format(n=rnd.randint(1, 99)) for _ in range(3000)]
    ru, zh = (" ".join(t.format(n=n) for t in ts for n in (3, 8)) for ts in (RU, ZH))
    chains = [("koi8_r", "cp1251", ru), ("cp1251", "koi8_r", ru), ("cp866", "cp1251", ru), ("cp1251", "mac_roman", ru), ("cp866", "cp437", ru), ("koi8_r", "cp850", ru), ("gb18030", "cp1251", zh), ("gb18030", "mac_roman", zh)]
    bad = [(t, wrong(t, right, read)) for right, read, t in chains]
    mixed = RU[0].format(n=4) + " " + wrong(ru, "koi8_r", "cp1251") + " " + RU[1].format(n=6)
    bad.append((" ".join([RU[0].format(n=4), ru, RU[1].format(n=6)]), mixed))
    rows = list(enumerate(clean)) + [(10_000 + i, b) for i, (_, b) in enumerate(bad)] + [(20_000, ru.upper()), (20_001, ru.swapcase())]
    got = {r["doc_id"]: r["text"] for r in mb.garbled_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {10_000 + i: t for i, (t, _) in enumerate(bad)}


def test_two_steps_through_every_ordered_pair():
    for first in mb.WRONG:
        for then in mb.WRONG:
            for run in ("Реакция", "°", "é"):
                assert run in mb.run_candidates(wrong(wrong(run, "utf-8", first), "utf-8", then)), (first, then, run)


def test_margins_by_kind(spark):
    rnd = random.Random(3)
    clean = [rnd.choice([*EN, *RU, *ZH, *DE]).format(n=rnd.randint(1, 99)) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(clean)), "doc_id bigint, text string")
    margins = mb.validated_margins(df, "doc_id", "text", mb.train(df, "doc_id", "text"))
    assert set(margins) == set(mb.KINDS) and all(mb.LEAST <= m <= 31 for m in margins.values())
    assert mb.validated_margins(df.limit(0), "doc_id", "text", mb.Model(mb.np.zeros(mb.UNI), mb.np.zeros(mb.BI))) == dict.fromkeys(mb.KINDS, mb.LEAST)
    assert mb.garble_line("Выход 5") is not None and mb.garble_line("plain") is None
    for run in ("Реакция", "é", "₂"):
        g = mb.garble_twice(run)
        assert g is None or mb.run_candidates(g).get(run)


def test_text_as_it_stands_is_scored_once():
    class Counting(mb.Model):
        calls = 0

        def score(self, text):
            self.calls += 1
            return super().score(text)

    rng = np.random.default_rng(3)
    model = Counting(rng.integers(0, 50, mb.UNI).astype(float), rng.integers(0, 9, mb.BI).astype(float))
    repair = mb.Repairer(model, dict.fromkeys(mb.KINDS, 2.0))
    gain, new = repair.best("a", "Ã©t", ["ét", "ýt", "žt"], "x")
    assert model.calls == 4
    assert (gain, new) == max((repair.gain("a", "Ã©t", n, "x"), n) for n in ("ét", "ýt", "žt"))
    assert repair.best("a", "b", [], "c") == (0.0, "b") and model.calls == 10


def test_wrong_readings_follow_the_byte_tables():
    every = bytes(range(256))
    for codec, back in mb.BACK.items():
        for b in every:
            assert mb.read_wrongly(bytes([b]), codec) == (chr(b) if b < 0x80 else back.get(b))
        for c, b in mb.TABLES[codec].items():
            assert mb.stretch_candidates("a" + c, codec, ("latin-1",)) == ([] if c == chr(b) else ["a" + chr(b)])
