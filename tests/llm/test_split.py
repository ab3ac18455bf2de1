from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm.split import Limits, exceeds, new_members, split_oversized, split_text

PARTS = st.sampled_from(["word ", "end. ", "line\n", "para.\n\n", "clause; ", "x" * 90, "　", " ", "漢字。", "1,2 "])


@settings(max_examples=150, deadline=None)
@given(st.lists(PARTS, max_size=400).map("".join))
def test_pieces_keep_limits_and_lose_nothing(text):
    lim = Limits(40, 300, 6)
    pieces = split_text(text, lim)
    assert bool(pieces) == (exceeds(text, lim) and bool(text.strip()))
    at = None
    for n, (s, e, own) in enumerate(pieces):
        piece = text[s:e]
        assert len(piece) <= lim.max_chars and len(piece.split()) <= lim.max_tokens and s <= own < e
        if n:
            assert not text[at:own].strip()
        at = e
    if pieces:
        assert not text[: pieces[0][2]].strip() and not text[at:].strip()


def test_full_overlap_and_natural_cuts():
    text = " ".join(f"Sentence number {k} has eight words in it." for k in range(300))
    pieces = split_text(text)
    assert all(len(text[s:own].split()) == 63 for s, _, own in pieces[1:])
    assert all(text[e - 1] == "." for _, e, _ in pieces)


def test_small_blank_and_huge():
    assert split_text(None) == split_text("") == split_text("a b") == split_text(" " * 9000) == []
    assert max(e - s for s, e, _ in split_text("x" * 200_000)) <= 4000


def test_rows(spark):
    big = "acid base. " * 400
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("s1", big, ["c1"], t), ("s1", big, ["c1"], datetime(2024, 2, 1)), ("s2", "small", ["c2"], t), ("s3", None, None, t), (None, big, None, t)], "section_id string, text string, member_chunk_ids array<string>, ingested_at timestamp").selectExpr("*", "1 AS piece_no")
    pieces = split_oversized(df)
    assert {r["section_id"] for r in pieces.select("section_id").collect()} == {"s1"}
    n = pieces.count()
    assert n == pieces.select("chunk_id").distinct().count() == len(split_text(big))
    members = {r["section_id"]: r["member_chunk_ids"] for r in new_members(df).collect()}
    assert len(members["s1"]) == n and members["s2"] == ["c2"] and members["s3"] is None


def test_members_of_the_latest_content_only(spark):
    long = lambda w: f"{w} base. " * 900
    t = [datetime(2024, m, 1) for m in (1, 2, 3)]
    df = spark.createDataFrame(
        [("s1", long("acid"), ["old"], t[0]), ("s1", long("salt"), ["new"], t[2]), ("s2", long("acid"), ["c"], t[0]), ("s2", "now short", ["d"], t[1]), ("s3", "x", None, None), ("s3", "y", ["e"], t[0])],
        "section_id string, text string, member_chunk_ids array<string>, ingested_at timestamp",
    )
    got = {r["section_id"]: r["member_chunk_ids"] for r in new_members(df).collect()}
    pieces = {r["chunk_id"]: r["text"] for r in split_oversized(df).collect()}
    assert len(got["s1"]) == len(split_text(long("salt"))) and all("salt" in pieces[c] for c in got["s1"])
    assert got["s2"] == ["d"] and got["s3"] == ["e"]
    assert new_members(df.limit(0)).count() == 0
