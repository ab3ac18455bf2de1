"""Held-out test texts inside a corpus, found by a generalised suffix automaton.

The normalised words of all test items go into one suffix automaton whose states know which items
contain their strings. Every corpus text is streamed through it word by word; the automaton's position
is always the longest run of words that ends here and occurs in some item. A run of at least `min_words`
words, or a whole item that is shorter, is a leak. Runs of words that no two neighbouring item words can
explain are skipped by array arithmetic beforehand, which changes no result.

Null, empty and wordless texts hold no leaks; wordless items leak nowhere. Items with the same text are
all reported. Repeated corpus rows repeat their rows. Texts are taken whole.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.words import WORD, words
from folioscope.runtime import Shared

MIN_WORDS = 13
#: Words of test items in one automaton, which bounds what the driver holds while it builds it, and the
#: automata that go through the corpus together, which bounds what a worker holds. Larger item tables take
#: several passes.
ITEM_WORDS, TOGETHER = 400_000, 5
SLICE_CHARS = 2 << 20


class Builder:
    """Generalised suffix automaton over word ids under construction; a string is inserted from the root each time."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def insert(self, seq: list[int]) -> None:
        last = 0
        for c in seq:
            last = self._extend(last, c)

    def _new(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        cur = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return cur


def grouped(pairs: list[tuple[int, int]], states: int) -> tuple[array, array]:
    """(where the values of each state begin, the values) of (state, value) pairs."""
    p = np.array(sorted(set(pairs)), np.int64).reshape(-1, 2)
    begin = np.searchsorted(p[:, 0], np.arange(states + 1))
    return array("i", begin.astype(np.int32).tobytes()), array("i", p[:, 1].astype(np.int32).tobytes())


class SuffixAutomaton:
    """Generalised suffix automaton of items in flat arrays.

    Most states have one way on, kept in `word` and `to`; the ways of the others are a sorted array of
    (state, word) keys, those of the root an array by word. Items are told by their number.
    """

    def __init__(self, items: list[list[str]], min_words: int = MIN_WORDS):
        self.min_words = min_words
        self.ids: dict[str, int] = {}
        seqs = [(i, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for i, ws in enumerate(items) if ws]
        b = Builder()
        for _, seq in seqs:
            b.insert(seq)
        n, states = max(1, len(self.ids)), len(b.next)
        self.shortest = min((min(len(s), min_words) for _, s in seqs), default=min_words)
        self.link, self.length = array("i", b.link), array("i", b.length)
        contains: list[tuple[int, int]] = []
        whole: list[tuple[int, int]] = []
        self.size = array("i", [len(ws) for ws in items])
        for key, seq in seqs:
            v, held = 0, set()
            for c in seq:
                v = b.next[v][c]
                u = v
                while b.length[u] >= min_words and u not in held:  # shorter runs are no leaks
                    held.add(u)
                    contains.append((u, key))
                    u = b.link[u]
            if len(seq) < min_words:
                while b.length[b.link[v]] >= len(seq):
                    v = b.link[v]
                whole.append((v, key))
        self.contains, self.whole = grouped(contains, states), grouped(whole, states)
        self.word, self.to = array("i", [-1]) * states, array("i", [0]) * states
        more: list[tuple[int, int]] = []
        for v, ways in enumerate(b.next):
            if v and len(ways) == 1:
                ((self.word[v], self.to[v]),) = ways.items()
            elif v and ways:
                self.word[v] = -2
                more += [(v * n + c, t) for c, t in ways.items()]
        more.sort()
        self.key, self.goal = array("q", [k for k, _ in more]), array("i", [t for _, t in more])
        self.root = array("i", [0]) * n
        for c, t in b.next[0].items():
            self.root[c] = t
        # by length, so that every link is complete before the states that lead to it
        self.top = array("i", [0]) * states  # the ancestor that holds the suffix of min_words words
        self.short = array("i", [0]) * states  # the nearest state on the way to the root that is a whole item
        begin = self.whole[0]
        for v in sorted(range(1, states), key=b.length.__getitem__):
            up = b.link[v]
            self.short[v] = v if begin[v] < begin[v + 1] else self.short[up]
            if b.length[v] >= min_words:
                self.top[v] = v if b.length[up] < min_words else self.top[up]
        pairs = {a * n + c for _, s in seqs for a, c in zip(s, s[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)

    def stream(self, ids: list[int]) -> dict[int, list[tuple[int, int]]]:
        """item -> maximal spans (first word, words) of ids that leak it."""
        out: dict[int, list[tuple[int, int]]] = {}
        v = n = 0
        word, to, link, length, root, keys = self.word, self.to, self.link, self.length, self.root, self.key
        size, at = max(1, len(self.ids)), self.contains[0]
        for i, c in enumerate(ids):
            while v:
                if word[v] == c:
                    v = to[v]
                    n += 1
                    break
                if word[v] == -2:
                    k = v * size + c
                    j = bisect_left(keys, k)
                    if j < len(keys) and keys[j] == k:
                        v = self.goal[j]
                        n += 1
                        break
                v = link[v]
                n = length[v]
            else:
                v = root[c]
                n = 1 if v else 0
            if n >= self.min_words:
                u, held, reach = self.top[v], set(), n
                # from the longest match up to the shortest that counts: each item by its longest run
                w = v
                while True:
                    for item in self.contains[1][at[w] : at[w + 1]]:
                        if item not in held:
                            held.add(item)
                            self._span(out, item, i - reach + 1, reach)
                    if w == u:
                        break
                    w = link[w]
                    reach = length[w]
            w = self.short[v]
            while w:
                begin, values = self.whole
                for item in values[begin[w] : begin[w + 1]]:
                    if self.size[item] <= n:
                        self._span(out, item, i - self.size[item] + 1, self.size[item])
                w = self.short[link[w]]
        return out

    @staticmethod
    def _span(out: dict[int, list[tuple[int, int]]], key: int, start: int, size: int) -> None:
        spans = out.setdefault(key, [])
        if spans and spans[-1][0] + spans[-1][1] >= start:
            first = min(spans[-1][0], start)
            spans[-1] = (first, max(spans[-1][0] + spans[-1][1], start + size) - first)
        else:
            spans.append((start, size))

    def scan(self, texts: list[list[str]]) -> Iterator[tuple[int, int, int, int]]:
        """(text number, item, first word, words) over many texts at once."""
        get, n = self.ids.get, max(1, len(self.ids))
        flat: list[int] = []
        starts = []
        for ws in texts:
            starts.append(len(flat))
            flat.extend([get(w, -1) for w in ws])
            flat.append(-1)
        a = np.array(flat, np.int64)
        known = a >= 0
        if self.shortest >= 2 and len(a) > 1:
            joined = np.zeros(len(a), bool)  # word i continues word i - 1 as in some item
            key = a[:-1] * n + a[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
            joined[1:] = known[:-1] & known[1:] & (self.pairs[at] == key if len(self.pairs) else False)
        else:
            joined = np.concatenate([[False], known[:-1] & known[1:]]) if len(a) else known
        begin = np.flatnonzero(known & ~joined)
        edge = np.flatnonzero(joined & ~np.concatenate([joined[1:], [False]])) if len(a) else begin
        # a run starts at a known word that continues nothing and ends at its last joined word
        end = begin.copy()
        if len(edge):
            k = np.searchsorted(begin, edge, "right") - 1
            end[k] = edge
        long = np.flatnonzero(end - begin + 1 >= self.shortest)
        where = np.searchsorted(starts, begin[long], "right") - 1
        for k, d in zip(long.tolist(), where.tolist()):
            s = int(begin[k])
            for item, spans in self.stream(flat[s : int(end[k]) + 1]).items():
                for first, size in spans:
                    yield d, item, s - starts[d] + first, size


def passes(items: DataFrame, item_id: str, item_text: str, min_words: int) -> Iterator[list[tuple[pa.Array, SuffixAutomaton]]]:
    """Lists of at most TOGETHER (item ids, automaton), each of about ITEM_WORDS words; the items are fetched in blocks of that size."""
    # a word has at least one character, and one between it and the next
    total = items.agg(F.sum(F.coalesce(F.length(item_text), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-int(total) // (2 * ITEM_WORDS)))
    ready = []
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks)) == k)
        rows = block.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).toArrow()
        ids = rows.column("item_id").combine_chunks()
        ready.append((ids, SuffixAutomaton([words(t) for t in rows.column("text").to_pylist()], min_words)))
        if len(ready) == TOGETHER:
            yield ready
            ready = []
    if ready:
        yield ready


def leaked_spans(corpus: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, item_id, first_word, n_words): the leaked spans of every corpus row; narrow, no shuffle.

    The automata are broadcast, their size bounded by ITEM_WORDS and TOGETHER; a larger item table is scanned for
    in several passes over the corpus.
    """
    spark = corpus.sparkSession
    src = corpus.select(key, text)
    kind, item_kind = src.schema[key].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    out = None
    for automata in passes(items, item_id, item_text, min_words):
        held = Shared(spark, automata)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            automata = held.get()
            for b in batches:
                keys = b.column(0)
                rows: list[int] = []
                low: list[str] = []
                parts: list[pa.RecordBatch] = []
                chars = 0

                def flush() -> None:
                    texts = [WORD.findall(t) for t in low]
                    for ids, auto in automata:
                        got = np.array(list(auto.scan(texts)), np.int64).reshape(-1, 4)
                        place = pa.array(np.array(rows, np.int64)[got[:, 0]] if len(got) else np.empty(0, np.int64))
                        parts.append(pa.RecordBatch.from_arrays([keys.take(place), ids.take(pa.array(got[:, 1])), pa.array(got[:, 2].astype(np.int32)), pa.array(got[:, 3].astype(np.int32))], names=[key, "item_id", "first_word", "n_words"]))

                for i, t in enumerate(b.column(1).to_pylist()):
                    if t:
                        rows.append(i)
                        low.append(t.lower())
                        chars += len(t)
                    if chars >= SLICE_CHARS:
                        flush()
                        rows, low, chars = [], [], 0
                flush()
                yield from parts

        part = src.mapInArrow(run, f"`{key}` {kind}, item_id {item_kind}, first_word int, n_words int")
        out = part if out is None else out.unionByName(part)
    return out


def word_places(text: str) -> list[tuple[int, int]]:
    """Where in the text each of its words() stands; lower-casing may lengthen a character and so split a word."""
    low = text.lower()
    places = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        return places
    source = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(source[s], source[e - 1] + 1) for s, e in places]


def without(text: str, spans: list[tuple[int, int]], max_coverage: float) -> tuple[str | None, int, bool]:
    """(text without the spans, or null where they cover too much of it; spans cut, dropped)."""
    merged: list[list[int]] = []
    for f, n in sorted(spans):
        if merged and f <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], f + n)
        else:
            merged.append([f, f + n])
    places = word_places(text)
    if sum(e - s for s, e in merged) > max_coverage * len(places):
        return None, len(merged), True
    keep, at = [], 0
    for s, e in merged:
        keep.append(text[at : places[s][0]])
        at = places[e - 1][1]
    return "".join([*keep, text[at:]]), len(merged), False


def remove_leaks(corpus: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, max_coverage: float = 0.5) -> DataFrame:
    """(key, text, n_removed, dropped) of every leaking row; other rows are not returned.

    Leaked spans are cut out from the first to the last of their words. Where they cover more than
    `max_coverage` of the row's words the whole text is dropped (text null, dropped true). One pass finds
    and cuts without any shuffle. An item table of several passes has its spans gathered per text - bounded by
    the text's own words - and joined to the corpus once; the result is the same.
    """
    spark = corpus.sparkSession
    src = corpus.select(key, text)
    kind = src.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{text}` string, n_removed int, dropped boolean"
    todo = passes(items, item_id, item_text, min_words)
    automata = next(todo)
    following = next(todo, None)

    def result(keys: pa.Array, rows: list[int], cut: list[tuple[str | None, int, bool]]) -> pa.RecordBatch:
        texts, counts, drops = zip(*cut) if cut else ((), (), ())
        return pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(drops, pa.bool_())], names=[key, text, "n_removed", "dropped"])

    if following is None:
        held = Shared(spark, [a for _, a in automata])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            autos = held.get()
            for b in batches:
                rows, cut = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    if not t:
                        continue
                    ws = words(t)
                    spans = {(f, n) for a in autos for _, _, f, n in a.scan([ws])}
                    if spans:
                        rows.append(i)
                        cut.append(without(t, list(spans), max_coverage))
                yield result(b.column(0), rows, cut)

        return src.mapInArrow(run, schema)

    content = F.md5(F.col(text))
    hashed = src.where(F.col(text).isNotNull()).select(F.struct(F.col(key).alias("k"), content.alias("h")).alias("row"), F.col(text).alias("text"))
    found = leaked_spans(hashed, items, "row", "text", item_id, item_text, min_words)
    spans = found.groupBy("row").agg(F.collect_set(F.struct("first_word", "n_words")).alias("spans")).select(F.col("row.k").alias("k"), F.col("row.h").alias("h"), "spans")

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [without(t, [(x["first_word"], x["n_words"]) for x in xs], max_coverage) for t, xs in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield result(b.column(0), list(range(b.num_rows)), cut)

    rows = src.select(F.col(key).alias("a"), F.col(text).alias("b"), content.alias("c"))
    both = rows.join(spans, F.col("a").eqNullSafe(F.col("k")) & (F.col("c") == F.col("h")))
    return both.select("a", "b", "spans").mapInArrow(cut_all, schema)
