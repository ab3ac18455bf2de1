"""Encoding of whole texts with a public byte-level BPE by forced-boundary splitting.

A pair of bytes that occurs inside no vocabulary token can never end up inside one output token, because
every intermediate product of byte-pair merging is itself a vocabulary token. Between two such bytes a
cut is therefore certain - provided the pre-tokenizer's pattern reads both sides as it would read the
whole. That holds when the cut is at a code point boundary, the byte before it is no white space (white
space looks ahead) and no apostrophe stands beside it (contractions span it); before white space after
a visible character the pattern always starts anew. Fragments between cuts repeat massively, so every
batch encodes each different fragment once and gathers the ids with array arithmetic.

Null and empty texts give an empty list. Texts may be of any length: batches are processed in slices of
bounded bytes, and a fragment without any cut is simply encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer's pattern (fixed value of the public vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE_BYTES = 4 << 20
CACHE_FRAGMENTS = 200_000


def load_ranks(path: str = DEFAULT_RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def certain_cuts(ranks: dict[bytes, int]) -> np.ndarray:
    """bool[256, 256]: True where a cut between the two bytes is certain and the pattern agrees."""
    cut = np.ones((256, 256), bool)
    for t in ranks:
        b = np.frombuffer(t, np.uint8)
        cut[b[:-1], b[1:]] = False
    space = [*range(9, 14), *range(28, 33)]
    quote = ord("'")
    cut[:, 0x80:0xC0] = False  # inside a code point
    cut[space, :] = False
    cut[:, quote] = False
    right_space = cut[quote, space].copy()
    cut[quote, :] = False
    cut[quote, space] = right_space
    # last bytes of multi-byte white space: U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000
    cut[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF], :] = False
    return cut


class ForcedBoundaryEncoder:
    def __init__(self, path: str = DEFAULT_RANKS):
        import tiktoken

        ranks = load_ranks(path)
        self.cut = certain_cuts(ranks).reshape(-1)
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache: dict[bytes, np.ndarray] = {}

    def fragments(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sorted byte positions at which fragments start or end; every text's ends are among them."""
        if len(data) < 2:
            return np.unique(offsets)
        pair = data[:-1].astype(np.uint16) << 8 | data[1:]
        inner = np.flatnonzero(self.cut[pair]) + 1
        return np.unique(np.concatenate([inner, offsets]))

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list offsets, ids) of the texts data[offsets[i]:offsets[i + 1]]."""
        if offsets[-1] == offsets[0]:
            return np.zeros(len(offsets), np.int64), np.empty(0, np.int32)
        at = self.fragments(data, offsets)
        column = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = column.dictionary_encode()
        codes = coded.indices.to_numpy()
        found = []
        if len(self.cache) > CACHE_FRAGMENTS:
            self.cache.clear()
        for f in coded.dictionary.to_pylist():
            ids = self.cache.get(f)
            if ids is None:
                ids = self.cache[f] = np.array(self.encode(f.decode("utf-8", "replace")), np.int32)
            found.append(ids)
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.concatenate(found)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        n = size[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begin[codes] - ends[:-1], n) + np.arange(ends[-1])]
        return ends[np.searchsorted(at, offsets)], ids

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """list<int32> of a string column."""
        texts = texts.fill_null("").cast(pa.large_string())
        raw = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] else np.empty(0, np.uint8)
        outs, i = [], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(raw, raw[i] + SLICE_BYTES, "right")) - 1)
            ends, ids = self.encode_slice(data[raw[i] : raw[j]], raw[i : j + 1] - raw[i])
            outs.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)))
            i = j
        return pa.concat_arrays(outs) if outs else pa.array([], pa.list_(pa.int32()))


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_path: str = DEFAULT_RANKS) -> DataFrame:
    """(key, ids array<int>): one row per input row, no shuffle; repeated keys stay repeated.

    Needs only the two named columns, so the scan is pruned to them; other columns, whatever their
    names, are never read. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            encoder = encoder or ForcedBoundaryEncoder(tokenizer_path)
            yield pa.RecordBatch.from_arrays([b.column(0), encoder.encode_column(b.column(1))], names=[key, "ids"])

    src = df.select(key, text)
    return src.mapInArrow(run, f"`{key}` {src.schema[key].dataType.simpleString()}, ids array<int>")
