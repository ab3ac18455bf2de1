"""Cutting oversized texts at natural boundaries by recursive bisection.

Tokens are runs of non-white-space characters. A text above `max_tokens` tokens or `max_chars` characters
is bisected: the strongest boundary in the middle half is taken, of equal ones the nearest to the
midpoint, and each half is cut again while it and the overlap before it exceed the limits. Then every
piece but the first gets the `overlap` tokens before it. A token too long for that (text without spaces)
is first divided into units of at most max_chars / 4 characters, at punctuation where there is any; the
overlap is shortened only where 63 such units and the piece would not fit together.

Null, empty and small texts give no pieces. Repeated rows of a key give the same pieces, which are
returned once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\S+")
SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
CLAUSE = re.compile(r"[;:；：][\"'”’»)\]]*$")
COMMA = re.compile(r"[,，、][\"'”’»)\]]*$")
SOFT = re.compile(r"[.!?…。！？;:；：,，、]")


@dataclass(frozen=True)
class Limits:
    max_tokens: int = 420
    max_chars: int = 4000
    overlap: int = 63


def exceeds(text: str | None, lim: Limits = Limits()) -> bool:
    if not text:
        return False
    return len(text) > lim.max_chars or (len(text) >= 2 * lim.max_tokens and len(text.split()) > lim.max_tokens)


def units_of(text: str, lim: Limits) -> list[tuple[int, int]]:
    """Spans of the tokens, over-long ones divided."""
    most = max(1, lim.max_chars // 4)
    out = []
    for m in TOKEN.finditer(text):
        s, e = m.span()
        while e - s > most:
            soft = [k.end() for k in SOFT.finditer(text, s + most // 2, s + most)]
            cut = soft[-1] if soft else s + most
            out.append((s, cut))
            s = cut
        if s < e:
            out.append((s, e))
    return out


def strengths(text: str, units: list[tuple[int, int]]) -> list[int]:
    """Strength of the boundary before each unit: paragraph 5, sentence 4, line 3, clause 2, comma 1, blank 0, none -1."""
    out = [6]
    for (s, e), (t, _) in zip(units, units[1:]):
        gap, tail = text[e:t], text[max(s, e - 4) : e]
        if gap.count("\n") > 1 or "\u2029" in gap:
            out.append(5)
        elif SENTENCE.search(tail):
            out.append(4)
        elif "\n" in gap or "\r" in gap:
            out.append(3)
        elif CLAUSE.search(tail):
            out.append(2)
        elif COMMA.search(tail):
            out.append(1)
        else:
            out.append(0 if gap else -1)
    return out


def split_text(text: str | None, lim: Limits = Limits()) -> list[tuple[int, int, int]]:
    """[(start, end, own)]: character spans of the pieces, own the first character that is no overlap."""
    if not exceeds(text, lim):
        return []
    units = units_of(text, lim)
    if not units:  # more than max_chars of white space: nothing to keep
        return []
    strong = strengths(text, units)

    def room(first: int, a: int, b: int) -> bool:
        return b - first <= lim.max_tokens and units[b - 1][1] - units[first][0] <= lim.max_chars

    def fits(a: int, b: int) -> bool:
        return room(max(0, a - lim.overlap), a, b) and (a == 0 or b - a <= lim.max_tokens - lim.overlap)

    pieces = []
    todo = [(0, len(units))]
    while todo:
        a, b = todo.pop()
        if b - a == 1 or fits(a, b):
            pieces.append((a, b))
            continue
        mid, reach = (a + b) // 2, max(1, (b - a) // 4)
        near = range(max(a + 1, mid - reach), min(b - 1, mid + reach) + 1)
        cut = max(near, key=lambda i: (strong[i], -abs(i - mid), -i))
        todo += [(cut, b), (a, cut)]
    out = []
    for a, b in pieces:
        first = max(0, a - lim.overlap)
        while not room(first, a, b) and first < a:
            first += 1
        out.append((units[first][0], units[b - 1][1], units[a][0]))
    return out


def piece_id(key: str, n: int, text: str) -> str:
    return "chunk_" + hashlib.sha1(f"{key}:{n}:{text}".encode("utf-8", "surrogatepass")).hexdigest()[:16]


def least_chars(lim: Limits) -> int:
    """Characters of the shortest text that can exceed the limits."""
    return min(lim.max_chars + 1, 2 * lim.max_tokens + 1)


def split_oversized(df: DataFrame, key: str = "section_id", text: str = "text", lim: Limits = Limits()) -> DataFrame:
    """(key, piece_no, chunk_id, char_start, char_end, own_start, n_tokens, text) of every oversized row.

    Rows that cannot exceed the limits are dropped by a length test in the JVM before any text reaches
    Python. Of re-ingested rows every distinct content is cut: pieces are deduplicated by key and
    chunk id, whose hash covers their number and text. Null keys are left out.
    """
    src = df.select(F.col(key).cast("string").alias(key), F.col(text).alias(text)).where(F.col(key).isNotNull() & (F.length(text) >= least_chars(lim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for n, (s, e, own) in enumerate(split_text(t, lim)):
                    for c, v in zip(cols, (k, n, piece_id(k, n, t[s:e]), s, e, own, len(t[s:e].split()), t[s:e])):
                        c.append(v)
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[key, "piece_no", "chunk_id", "char_start", "char_end", "own_start", "n_tokens", "text"])

    return src.mapInArrow(run, f"`{key}` string, piece_no int, chunk_id string, char_start int, char_end int, own_start int, n_tokens int, text string").dropDuplicates([key, "chunk_id"])


def new_members(sections: DataFrame, key: str = "section_id", members: str = "member_chunk_ids", text: str = "text", order: str = "ingested_at", lim: Limits = Limits()) -> DataFrame:
    """(key, member_chunk_ids): every section with its new chunk ids, unsplit ones with their own.

    Only the latest row of a section counts (by time, nulls first, then by content). It is told by a hash, so no
    text is shuffled to find it. A section's list is bounded by its own text, so collecting it per key is safe.
    """
    content = F.md5(F.coalesce(F.col(text), F.lit("")))
    rows = sections.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key), F.col(members).alias(members), F.col(order).alias("at"), content.alias("content"))
    at = F.struct(F.col("at").isNotNull(), "at", "content", F.xxhash64(members))
    latest = rows.groupBy(key).agg(F.max_by(F.struct(members, "content"), at).alias("r")).select(key, f"r.{members}", "r.content")
    large = sections.where(F.length(text) >= least_chars(lim)).select(F.col(key).cast("string").alias(key), F.col(text).alias(text), content.alias("content"))
    current = large.join(latest.select(key, "content"), [key, "content"], "left_semi")
    ids = split_oversized(current, key, text, lim).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "chunk_id"))), lambda x: x["chunk_id"]).alias("fresh"))
    return latest.join(ids, key, "left").select(key, F.coalesce("fresh", members).alias(members))
