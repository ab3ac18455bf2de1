"""Text decoded with a wrong character encoding: found and, where possible, restored.

Model: a smoothed character bigram model, its counts hashed into tables of fixed size and summed over all
clean records (no replacement or C1 control characters, nothing any chain could turn into other text).

Candidates: chains of up to two steps "encode with the codec it was wrongly read in, decode with the
right one", the codecs of two steps to UTF-8 being any ordered pair. Chains that end in UTF-8 are tried on every
run of non-ASCII characters, valid multi-byte sequences in it being replaced; chains that end in a legacy charset are tried, for every pair of a wrong and
a right codec, on stretches with three high characters in a row. Between Cyrillic charsets every run changes
by itself, so the consecutive runs that gain most together are taken, and clean ones beside them stay; small and
capital Cyrillic letters count as one there, since KOI8-R and cp1251 swap them. No chain is certain by its bytes
there, so Cyrillic records that are garbled so are among those the model is trained on; they are told by being
rarer than the clean ones. Each candidate is scored by the model in its context against the text as it stands;
the likeliest is accepted when it gains more than the margin of its kind: one step or two to UTF-8, to a legacy
charset, between Cyrillic ones. The margins are validated on held-out clean records garbled here: every run
by every chain of one step, and by one chain of two, and every line by one pair of a wrong and a legacy codec, which
its hash picks. A margin is the gain that all but `MISS` of the garbled pieces of its kind exceed, but no more than that
of one step, whose pieces are as short as garbled pieces get (whole lines gain more than the single words that may
be garbled elsewhere); where stretches of clean records gain as much as they stand, it is raised until no more than
`FALSE` of them are taken, and it is never under `LEAST` nats.

A record is affected when a chain was accepted, or when it holds U+FFFD or C1 control characters (other
than NEL, a line end), which no correct decoding of text yields; those may be beyond restoring.

Null, empty and pure ASCII texts are never affected. Texts are taken whole; repeated rows repeat.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.runtime import Shared

UNI, BI = 1 << 16, 1 << 19
LEAST, MISS, FALSE = 2.0, 0.001, 0.0001
KINDS = ("one", "two", "legacy", "swap")
#: One clean record in so many is held out of training for the margin.
HELD_OUT = 20

RUN = re.compile(r"[^\x00-\x7f]+")
LOST = re.compile("[�\x80-\x84\x86-\x9f]")
UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


def byte_of(codec: str) -> dict[str, int]:
    """char -> byte of a single-byte codec; bytes it leaves undefined stand for themselves."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):
        out.setdefault(chr(b), b)
    if codec == "cp1252":  # Latin-1 and Windows-1252 are mixed up everywhere; one table reads both
        for b in range(0xA0, 0x100):
            out.setdefault(chr(b), b)
    return out


#: Codecs in which UTF-8 is wrongly read, and charsets that are wrongly read in one of these (fixed values).
WRONG = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp1250")
LEGACY = ("cp1251", "koi8_r", "gb18030", "cp932", "euc_jp", "big5", "euc_kr", "cp866")
TABLES = {c: byte_of(c) for c in WRONG}
#: The same with ASCII, as the character map encoder of the interpreter takes it.
ENCODE = {c: {b: b for b in range(0x80)} | {ord(ch): b for ch, b in t.items()} for c, t in TABLES.items()}
HIGH = {c: "".join(map(re.escape, t)) for c, t in TABLES.items()}
THREE = {c: re.compile(f"[{h}]{{3}}") for c, h in HIGH.items()}
STRETCH = {c: re.compile(f"[\\x20-\\x7e{h}]+") for c, h in HIGH.items()}
ANY3 = re.compile(f"[{''.join(HIGH.values())}]{{3}}")
#: Three characters in a row of a wrong reading that is not in Cyrillic letters.
LATIN3 = re.compile(f"[{''.join(HIGH[c] for c in WRONG if c not in LEGACY)}]{{3}}")
#: The Cyrillic charsets, and what becomes of each character of one that was read as another.
SINGLE = {c: {b: ch for b in range(0x80, 0x100) if (ch := bytes([b]).decode(c, "ignore"))} for c in ("cp1251", "koi8_r", "cp866")}
MULTI = tuple(c for c in LEGACY if c not in SINGLE)
SWAPS = {(w, r): {ord(c): SINGLE[r][b] for c, b in TABLES[w].items() if b in SINGLE[r]} for w in WRONG if w in SINGLE for r in SINGLE if w != r}
#: Bigram context classes of ASCII: letters and digits each count as one.
CLASS = np.arange(128, dtype=np.uint32)
CLASS[[*range(65, 91), *range(97, 123)]] = 97
CLASS[[*range(48, 58)]] = 48


def as_utf8(run: str, codec: str) -> str | None:
    """run with the valid UTF-8 sequences of its bytes decoded; None when there are none."""
    table = TABLES[codec]
    if not any(table.get(c, 0) >= 0xC2 for c in run):
        return None
    out, part, hit = [], [], False

    def flush() -> None:
        nonlocal hit
        if part:
            raw, at = bytes(table[c] for c in part), 0
            for m in UTF8.finditer(raw):
                out.append("".join(part[at : m.start()]) + m.group().decode())
                at, hit = m.end(), True
            out.append("".join(part[at:]))
            part.clear()

    for c in run:
        if c in table:
            part.append(c)
        else:
            flush()
            out.append(c)
    flush()
    return "".join(out) if hit else None


def run_candidates(run: str) -> dict[str, str]:
    """Everything the chains of one or two steps make of a run, with their kind."""
    found: dict[str, str] = {}
    for codec in WRONG:
        one = as_utf8(run, codec)
        if one is not None and one != run:
            found[one] = "one"
            for again in WRONG:
                two = as_utf8(one, again)
                if two is not None and two != one:
                    found.setdefault(two, "two")
    return found


def stretches(text: str, codec: str = "cp1252") -> list[tuple[int, int]]:
    """Parts of lines that the wrong codec can encode and that have three high characters in a row."""
    out, at = [], 0
    while m := THREE[codec].search(text, at):
        begin = max(text.rfind("\n", 0, m.start()), text.rfind("\r", 0, m.start())) + 1
        for part in STRETCH[codec].finditer(text, max(begin, at)):
            if part.end() >= m.end():
                break
        out.append(part.span())
        at = part.end()
    return out


def stretch_candidates(text: str, wrong: str = "cp1252", rights: tuple[str, ...] = LEGACY) -> list[str]:
    raw = codecs.charmap_encode(text, "strict", ENCODE[wrong])[0]
    found: dict[str, None] = {}
    for codec in rights:
        try:
            found[raw.decode(codec)] = None
        except UnicodeDecodeError:
            pass
    return [f for f in found if f != text]


def codes(text: str) -> np.ndarray:
    """Code points, ASCII reduced to context classes."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if text.isascii():
        return CLASS[c]
    return np.where(c < 128, CLASS[np.minimum(c, 127)], c)


def small(c: np.ndarray) -> np.ndarray:
    """Code points, Cyrillic capitals made small."""
    return np.where((c >= 0x410) & (c < 0x430), c + 32, np.where((c >= 0x400) & (c < 0x410), c + 80, c)).astype(np.uint32)


def capital(c: np.ndarray) -> np.ndarray:
    return np.where((c >= 0x430) & (c < 0x450), c - 32, np.where((c >= 0x450) & (c < 0x460), c - 80, c)).astype(np.uint32)


def slots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Table slots of bigrams."""
    h = first.astype(np.uint64)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h += second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h &= np.uint64(BI - 1)
    return h.view(np.int64)


def pair_slots(c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Table slots of the bigrams that begin at the given places."""
    return slots(c[at], c[at + 1])


def see(c: str) -> str:
    """A character as the model sees it: ASCII letters and digits by class."""
    return chr(CLASS[ord(c)]) if c and c < "\x80" else c


class Model:
    """Interpolated bigram model over hashed counts."""

    def __init__(self, uni: np.ndarray, bi: np.ndarray):
        self.uni, self.bi, self.total = uni, bi, float(uni.sum())
        self.weight, self.alpha = 8.0, 0.02

    def score(self, text: str) -> float:
        """Log-probability of all but the first character."""
        c = codes(text)
        if len(c) < 2:
            return 0.0
        uni = self.uni[c & (UNI - 1)]
        p = (uni[1:] + self.alpha) / (self.total + self.alpha * UNI)
        p *= self.weight
        p += self.bi[slots(c[:-1], c[1:])]
        p /= uni[:-1] + self.weight
        return float(np.log(p, out=p).sum())

    def caseless(self, text: str) -> float:
        """The score where Cyrillic letters count in either case: the counts of all their forms together."""
        c = small(codes(text))
        if len(c) < 2:
            return 0.0
        up, at = capital(c), np.arange(len(c) - 1)
        both = up != c
        uni = self.uni[c % UNI] + both * self.uni[up % UNI]
        bi = self.bi[pair_slots(c, at)]
        for first, second in ((up, c), (c, up), (up, up)):
            real = (both[:-1] | (first is c)) & (both[1:] | (second is c))
            h = np.stack([first[:-1], second[1:]], 1).ravel()
            bi = bi + real * self.bi[pair_slots(h, at * 2)]
        p = (bi + self.weight * (uni[1:] + self.alpha) / (self.total + self.alpha * UNI)) / (uni[:-1] + self.weight)
        return float(np.log(p).sum())


class Repairer:
    def __init__(self, model: Model | None, margins: dict[str, float]):
        self.model, self.margins = model, margins
        self.cache: dict[str, dict[str, str]] = {}
        self.known: dict[tuple[str, str, str], tuple[float, str]] = {}
        self.swapped: dict[tuple[str, str, str], dict[tuple[str, str], float]] = {}

    def candidates(self, run: str) -> dict[str, str]:
        got = self.cache.get(run)
        if got is None:
            if len(self.cache) > 100_000:
                self.cache.clear()
            got = self.cache[run] = run_candidates(run)
        return got

    def suspicious(self, text: str) -> bool:
        """Whether a chain could make anything else of the text, or something was lost for certain."""
        return bool(LOST.search(text)) or bool(LATIN3.search(text)) or any(map(self.candidates, set(RUN.findall(text))))

    def gain(self, before: str, old: str, new: str, after: str) -> float:
        b, a = before[-1:] or "\n", after[:1] or "\n"
        return self.model.score(b + new + a) - self.model.score(b + old + a)

    def best(self, before: str, old: str, options: Iterable[str], after: str) -> tuple[float, str]:
        options = list(options)
        if not options:
            return 0.0, old
        b, a = before[-1:] or "\n", after[:1] or "\n"
        stands = self.model.score(b + old + a)
        return max((self.model.score(b + new + a) - stands, new) for new in options)

    def best_of_run(self, before: str, run: str, after: str) -> tuple[float, str]:
        """best() over the run's own candidates, remembered by what the model sees of the context."""
        key = (see(before) or "\n", run, see(after) or "\n")
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[key] = self.best(key[0], run, self.candidates(run), key[2])
        return got

    def fix_runs(self, text: str) -> tuple[str, int]:
        n = 0

        def replace(m: re.Match) -> str:
            nonlocal n
            if options := self.candidates(m.group()):
                gain, new = self.best_of_run(text[max(0, m.start() - 1) : m.start()], m.group(), text[m.end() : m.end() + 1])
                if gain > self.margins[options.get(new, "one")]:
                    n += 1
                    return new
            return m.group()

        return RUN.sub(replace, text), n

    def swap_gains(self, before: str, run: str, after: str) -> dict[tuple[str, str], float]:
        """What each pair of Cyrillic charsets that can make something else of the run gains by it."""
        key = (see(before) or "\n", run, see(after) or "\n")
        got = self.swapped.get(key)
        if got is None:
            if len(self.swapped) > 50_000:
                self.swapped.clear()
            got, old = {}, None
            for pair, table in SWAPS.items():
                if all(ord(c) in table for c in run):
                    old = self.model.caseless(key[0] + run + key[2]) if old is None else old
                    got[pair] = self.model.caseless(key[0] + run.translate(table) + key[2]) - old
            self.swapped[key] = got
        return got

    def swaps(self, text: str) -> list[tuple[float, int, int, str]]:
        """(gain, begin, end, new) of the consecutive runs that gain more than the margin together."""
        runs = [(m.start(), m.end(), self.swap_gains(text[max(0, m.start() - 1) : m.start()], m.group(), text[m.end() : m.end() + 1])) for m in RUN.finditer(text)]
        out = []
        for pair in {p for *_, gains in runs for p, g in gains.items() if g > 0}:
            at = 0
            while at < len(runs):
                total = top = 0.0
                last = at
                for i in range(at, len(runs)):
                    total += runs[i][2].get(pair, -np.inf)
                    if total > top:
                        top, last = total, i
                    if total <= max(0.0, top - self.margins["swap"]):
                        break
                begin, end = runs[at][0], runs[last][1]
                if top > self.margins["swap"] and THREE[pair[0]].search(text, begin, end):
                    out.append((top, begin, end, text[begin:end].translate(SWAPS[pair])))
                at = last + 1
        return out

    def best_of_stretch(self, text: str, s: int, e: int, wrong: str) -> tuple[float, str]:
        return self.best(text[max(0, s - 1) : s], text[s:e], stretch_candidates(text[s:e], wrong, MULTI if wrong in SINGLE else LEGACY), text[e : e + 1])

    def legacy(self, text: str) -> list[tuple[float, int, int, str]]:
        """(gain, begin, end, new) of the parts to which a chain to a legacy charset gives more than the margin."""
        out = self.swaps(text)
        for codec in WRONG:
            for s, e in stretches(text, codec):
                gain, new = self.best_of_stretch(text, s, e, codec)
                if gain > self.margins["legacy"]:
                    out.append((gain, s, e, new))
        return sorted(out, key=lambda x: (-x[0], *x[1:]))

    def fix(self, text: str) -> tuple[str, int]:
        """(restored text, number of places restored)."""
        # most texts hold nothing that any chain could change; their runs repeat, so the set of them is small
        three = ANY3.search(text)
        if not three and not any(map(self.candidates, set(RUN.findall(text)))):
            return text, 0
        taken: list[tuple[int, int, str]] = []
        for gain, s, e, new in self.legacy(text) if three else ():
            if all(e <= a or s >= b for a, b, _ in taken):
                # UTF-8 chains compete, but work on whole runs, which may reach beyond the part
                a, b = s, e
                while a and text[a - 1] > "\x7f":
                    a -= 1
                while b < len(text) and text[b] > "\x7f":
                    b += 1
                if gain > self.gain(text[max(0, a - 1) : a], text[a:b], self.fix_runs(text[a:b])[0], text[b : b + 1]):
                    taken.append((s, e, new))
        out, at, n = [], 0, len(taken)
        for s, e, new in sorted(taken):
            fixed, k = self.fix_runs(text[at:s])
            out += [fixed, new]
            at, n = e, n + k
        fixed, k = self.fix_runs(text[at:])
        return "".join([*out, fixed]), n + k


BACK = {c: {b: ch for ch, b in t.items()} for c, t in TABLES.items()}
#: Character of each byte; U+FFFE stands for none.
DECODE = {c: "".join(chr(b) if b < 0x80 else back.get(b, "\ufffe") for b in range(0x100)) for c, back in BACK.items()}


def read_wrongly(raw: bytes, wrong: str) -> str | None:
    """The bytes as the wrong codec shows them; None when it can't hold them all."""
    try:
        return codecs.charmap_decode(raw, "strict", DECODE[wrong])[0]
    except UnicodeDecodeError:
        return None


def garble(run: str) -> Iterator[str]:
    """The run as every chain of one step from UTF-8 would have garbled it, where the codec can hold all its bytes."""
    for codec in WRONG:
        if (g := read_wrongly(run.encode("utf-8", "surrogatepass"), codec)) is not None:
            yield g


def pick(text: str, n: int) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big") % n


def garble_twice(run: str) -> str | None:
    """The run garbled by one of the chains of two steps."""
    k = pick(run, len(WRONG) ** 2)
    once = read_wrongly(run.encode("utf-8", "surrogatepass"), WRONG[k % len(WRONG)])
    return None if once is None else read_wrongly(once.encode("utf-8", "surrogatepass"), WRONG[k // len(WRONG)])


def garble_line(line: str) -> tuple[str, str, str] | None:
    """(line garbled by one pair of a wrong and a legacy codec, these), where they can hold it."""
    able = []
    for right in LEGACY:
        try:
            able.append((right, line.encode(right)))
        except UnicodeEncodeError:
            pass
    options = [(g, wrong, right) for right, raw in able for wrong in WRONG if wrong != right and (g := read_wrongly(raw, wrong)) is not None and THREE[wrong].search(g)]
    return options[pick(line, len(options))] if options else None


def train(df: DataFrame, key: str, text: str) -> Model:
    """Counts over all clean records; what reaches the driver is bounded by the tables' fixed sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni, bi = np.zeros(UNI, np.int64), np.zeros(BI, np.int64)
        check = Repairer(None, {})
        for b in batches:
            singles, pairs = [], []
            for t in b.column(0).to_pylist():
                if not t or (not t.isascii() and check.suspicious(t)):
                    continue
                c = codes("\n" + t)
                singles.append(c % UNI)
                wide = c > 127
                at = np.flatnonzero(wide[:-1] | wide[1:])
                if len(at):
                    pairs.append(pair_slots(c, at))
            if singles:
                uni += np.bincount(np.concatenate(singles), minlength=UNI)
            if pairs:
                bi += np.bincount(np.concatenate(pairs), minlength=BI)
        for kind, counts in ((0, uni), (1, bi)):
            at = np.flatnonzero(counts)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(counts[at])], names=["kind", "slot", "n"])

    train_on = df.where(F.col(text).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(HELD_OUT)) != 0)).select(text)
    sums = train_on.mapInArrow(run, "kind int, slot bigint, n bigint").groupBy("kind", "slot").agg(F.sum("n").alias("n")).toArrow()
    kind, slot, n = (sums.column(i).to_numpy() for i in range(3))
    uni, bi = np.zeros(UNI), np.zeros(BI)
    uni[slot[kind == 0]] = n[kind == 0]
    bi[slot[kind == 1]] = n[kind == 1]
    return Model(uni, bi)


def validated_margins(df: DataFrame, key: str, text: str, model: Model) -> dict[str, float]:
    """The margin of each kind, from histograms of fixed size of the gains on held-out clean records."""
    shared = Shared(df.sparkSession, model)
    top = 60

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = Repairer(shared.get(), dict.fromkeys(KINDS, 0.0))
        bins = np.zeros((2, len(KINDS), top + 1), np.int64)
        done: dict[tuple[str, str, str], list[tuple[int, int]]] = {}

        def place(gain: float) -> int:
            return int(min(top, max(0, gain * 2)))

        def of_run(before: str, clean: str, after: str) -> list[tuple[int, int]]:
            out = []
            for kind, g in [*((0, g) for g in garble(clean)), (1, garble_twice(clean))]:
                if g is not None and clean in (options := check.candidates(g)):
                    out.append((kind, place(check.best(before, g, options, after)[0])))
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                if t.isascii() or check.suspicious(t):
                    continue
                for m in RUN.finditer(t):
                    k = (t[m.start() - 1 : m.start()] if m.start() else "", m.group(), t[m.end() : m.end() + 1])
                    if k not in done:
                        if len(done) > 50_000:
                            done.clear()
                        done[k] = of_run(*k)
                    for kind, x in done[k]:
                        bins[0, kind, x] += 1
                for line in set(t.splitlines()):
                    if line.isascii():
                        continue
                    for wrong in WRONG if ANY3.search(line) else ():
                        for s, e in stretches(line, wrong):
                            bins[1, 2, place(check.best_of_stretch(line, s, e, wrong)[0])] += 1
                    if (g := garble_line(line)) is None:
                        continue
                    garbled, wrong, right = g
                    if (wrong, right) in SWAPS:
                        gains = [x.get((wrong, right), 0.0) for m in RUN.finditer(garbled) if (x := check.swap_gains(garbled[max(0, m.start() - 1) : m.start()], m.group(), garbled[m.end() : m.end() + 1]))]
                        bins[0, 3, place(sum(gains))] += 1
                    else:
                        bins[0, 2, place(max((check.best_of_stretch(garbled, s, e, wrong)[0] for s, e in stretches(garbled, wrong)), default=0.0))] += 1
        kind, x = (a.ravel() for a in np.meshgrid(np.arange(2 * len(KINDS)), np.arange(top + 1), indexing="ij"))
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(x), pa.array(bins.ravel())], names=["kind", "bin", "n"])

    held = df.where(F.col(text).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(HELD_OUT)) == 0)).select(text)
    bins = np.zeros((2, len(KINDS), top + 1))
    for r in held.mapInArrow(run, "kind bigint, bin bigint, n bigint").groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect():
        bins[r["kind"] // len(KINDS), r["kind"] % len(KINDS), r["bin"]] = r["n"]
    missed = {k: float(np.searchsorted(np.cumsum(x) / x.sum(), MISS, "right")) / 2 for k, x in zip(KINDS, bins[0]) if x.sum()}
    strictest = missed.get("one", min(missed.values(), default=LEAST))
    margins = {}
    for kind, clean in zip(KINDS, bins[1]):
        margins[kind] = max(LEAST, min(strictest, missed.get(kind, strictest)))
        if clean.sum():
            taken = 1 - np.cumsum(clean) / clean.sum()  # the share beyond each bin
            margins[kind] = max(margins[kind], (int(np.argmax(taken <= FALSE)) + 1) / 2)
    return margins


def garbled_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n_restored, lost) of the affected rows: the restored text, the places restored and
    whether characters remain that were lost for good. Two passes train and validate, one repairs."""
    spark = df.sparkSession
    src = df.select(key, text)
    model = train(src, key, text)
    shared = Shared(spark, (model, validated_margins(src, key, text, model)))
    kind = src.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repairer(*shared.get())
        for b in batches:
            rows, texts, counts, lost = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if not t or t.isascii():
                    continue
                fixed, n = repair.fix(t)
                gone = bool(LOST.search(fixed))
                if n or gone:
                    rows.append(i)
                    texts.append(fixed)
                    counts.append(n)
                    lost.append(gone)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(lost, pa.bool_())], names=[key, text, "n_restored", "lost"])

    return src.mapInArrow(run, f"`{key}` {kind}, `{text}` string, n_restored int, lost boolean")
