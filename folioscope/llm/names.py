"""Variant spellings of person and institution names, linked.

1. Every distinct stored string is parsed into comparable parts: persons into family and given names (titles,
   markers, case and accents aside; reversed order told by which token stands first elsewhere),
   institutions into proper name, kind and town (departments aside, abbreviated kinds written out).
2. Every distinct parsed name is a sparse unit vector of character trigrams: those of the family or proper name, of
   the given name or town, each weighted by root idf, and of the initial or the words of the kind, in the shares
   `SHARES`. A given name stands for the names it is short for as well.
3. Candidates come from a distributed sparse join over the family or proper name's part of the vectors: all pairs of a
   block (possible given initial, or kind) whose cosine there reaches `MIN_PART`. Only a vector's rarest
   features are joined on (prefix filtering: what is left out cannot reach the threshold alone), so common
   trigrams make no pairs, and what a common one or a common name does make is divided into blocks. Every partner
   above the threshold is kept, not the n best.
4. The cosine of the full vectors decides: pairs of at least `MIN_COSINE` are links, and it is their weight. An exact
   check follows, which only takes away: names that contradict each other (another given name, middle initial,
   kind or town; a family name more than two edits away) are no link, and two typos at once weigh no more than `WEAK`.
5. The links fall into components, each of which is clustered by average linkage of the cosines, absent
   pairs counting as 0. A component above `MAX_LINKS` is first merged by rounds of reciprocal nearest
   neighbours, the same clustering done by joins.

Null and blank strings are no names. Identical strings are one; extra columns are never read; strings without
any letter are linked to nothing.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.graph import components
from folioscope.runtime import Shared, cut

MIN_PART, MIN_COSINE, MAX_LINKS = 0.35, 0.45, 200_000
#: Weight of pairs that may join a cluster through others but make none themselves.
WEAK = 0.4
#: Shares of a vector's parts in its squared length: family or proper name, initial or kind, given name or town.
SHARES = (0.6, 0.15, 0.25)
#: Slots of the table of document frequencies of the second and third part, a bound for what is broadcast.
SLOTS = 1 << 16
#: Names of one bucket that meet in one task; larger buckets are divided into blocks of this size.
BLOCK = 2000
#: Edits by which two family or proper names of one entity may differ.
MOST_EDITS = 2

#: Titles, markers of departments, kinds of institution with their abbreviated words.
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "phd", "sir", "jr", "sr", "md"}
UNIT_WORDS = {"department", "dept", "faculty", "lab", "laboratory", "division", "group", "section", "fac", "dep"}
KIND_WORDS = {
    "university": "university", "univ": "university",
    "institute": "institute", "inst": "institute", "technology": "technology", "technol": "technology", "tech": "technology",
    "academy": "academy", "acad": "academy", "sciences": "sciences", "science": "sciences", "sci": "sciences",
    "research": "research", "res": "research", "centre": "centre", "center": "centre", "ctr": "centre",
    "medical": "medical", "med": "medical", "school": "school", "sch": "school",
    "polytechnic": "polytechnic", "polytech": "polytechnic", "college": "college", "coll": "college", "hospital": "hospital", "hosp": "hospital",
}
SMALL = {"of", "for", "the", "and", "de", "at", "in"}
#: Letters that decompose into nothing.
PLAIN = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th"})


#: Marks names without parts, which meet only each other, as whole strings.
UNPARSED = "="


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s.lower()).translate(PLAIN)
    return "".join(c for c in s if not unicodedata.combining(c))


def distance(a: str, b: str, most: int = 2) -> int:
    """Edits (insert, delete, substitute, swap of neighbours) between a and b, or most + 1 beyond."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def person_tokens(name: str) -> tuple[list[str], list[str] | None]:
    """(tokens before the comma, tokens after it or None); dots after initials and short forms are kept."""
    s = fold(re.sub(r"[\d*†‡§#^]+([,;]\s*[\d*†‡§#^]+)*\s*$", "", name.strip()))
    s = re.sub(r"[\d*†‡§#^]", "", s)
    s = re.sub(r"\.(?=\w{2})", ". ", s)
    parts = [p for p in s.split(",") if p.strip()]

    def tokens(p: str) -> list[str]:
        out = []
        for t in re.findall(r"[^\W_]+(?:['’-][^\W_]+)*\.?", p):
            if t.rstrip(".") in TITLES:
                continue
            out.append(t)
        return out

    lists = [x for x in map(tokens, parts) if x]
    if not lists:
        return [], None
    return (lists[0], [t for x in lists[1:] for t in x]) if len(lists) > 1 else (lists[0], None)


def two_full(head: list[str], tail: list[str] | None) -> tuple[str | None, str | None]:
    """The two full tokens of a name without a comma, whose order may be reversed; else nothing."""
    full = [t for t in head if len(t.rstrip(".")) > 1 and not t.endswith(".")]
    return (full[0], full[1]) if tail is None and len(full) == 2 else (None, None)


def parse_person(name: str, upper_short: set[str], swap: bool) -> tuple[str, list[str]] | None:
    """(family, given parts): a part is a full name, a prefix ending in '.', or one letter."""
    head, tail = person_tokens(name)
    if not head:
        return None
    full = [t for t in head if len(t.rstrip(".")) > 1 and not t.endswith(".")]
    if tail:
        family, given = head, tail
    elif len(head) == 1:
        family, given = head, []
    else:
        last = head[-1].rstrip(".")
        # initials behind the name: one block of capitals, or single letters
        if len(last) <= 3 and last in upper_short and len(head[0].rstrip(".")) > 3:
            family, given = head[:-1], list(last)
        elif len(last) == 1:
            family, given = [t for t in head if len(t.rstrip(".")) > 1][:1] or head[:1], [t for t in head if len(t.rstrip(".")) == 1]
        else:
            family, given = head[-1:], head[:-1]
            if swap and len(full) == 2:
                family, given = [full[0]], [t for t in head if t != full[0]]
    given = [t if (t.endswith(".") and len(t) > 2) else t.rstrip(".") for t in given]
    return "".join(re.sub(r"[^\w]", "", t) for t in family), [g for g in given if g]


def given_match(a: str, b: str, full_of: dict[str, set[str]]) -> float:
    """Agreement of two given names, from 0 (different) to 1."""
    x, y = a.rstrip("."), b.rstrip(".")
    if len(x) > len(y):
        a, b, x, y = b, a, y, x
    fx, fy = {x} | full_of.get(x, set()), {y} | full_of.get(y, set())
    if len(x) == 1 or len(y) == 1:
        return 0.75 if any(p[0] == q[0] for p in ({x} if len(x) == 1 else fx) for q in ({y} if len(y) == 1 else fy)) else 0.0
    if x == y:
        return 1.0
    if fx & fy:
        return 0.95
    if (a.endswith(".") and any(q.startswith(x) for q in fy)) or (b.endswith(".") and any(p.startswith(y) for p in fx)):
        return 0.9
    # one typo, also in a full name that the other side abbreviates by a nickname
    if any(min(len(p), len(q)) >= 4 and distance(p, q, 1) <= 1 for p in fx for q in fy):
        return 0.85
    # two typos of one name are two edits apart; as little as two typos in different parts, see person_check
    if min(len(x), len(y)) >= 6 and distance(x, y, 2) == 2:
        return WEAK
    return 0.0


#: Agreement of two names that differ as two different typos of one name do.
TWO_TYPOS = 0.5


def family_match(a: str, b: str) -> float:
    if a == b:
        return 1.0
    short = min(len(a), len(b))
    if short >= 5 and (d := distance(a, b, 2)) <= 2:
        return 0.85 if d == 1 else TWO_TYPOS if short >= 7 else 0.0
    return 0.0


def person_check(a: tuple[str, list[str]], b: tuple[str, list[str]], full_of: dict[str, set[str]]) -> float:
    f = family_match(a[0], b[0])
    if not a[1] and not b[1]:
        return f if f > TWO_TYPOS else 0.0
    if not f or not a[1] or not b[1]:
        return 0.0
    g = given_match(a[1][0], b[1][0], full_of)
    if not g or (f < 1 and g == WEAK):
        return 0.0
    for x, y in zip(a[1][1:2], b[1][1:2]):
        if x[0] != y[0]:
            return 0.0
    # one typo is a typo; two, or a typo and a bare initial, join a cluster but make none
    return f * g if f == 1 or (g > 0.85 and f > TWO_TYPOS) else WEAK


def nearest_kind(t: str) -> str | None:
    if t in KIND_WORDS:
        return KIND_WORDS[t]
    if len(t) >= 6:
        for k, v in KIND_WORDS.items():
            if len(k) >= 6 and (distance(t, k, 1) == 1 or (len(t) <= len(k) + 4 and t.endswith(k))):
                return v
    return None


def parse_organisation(name: str) -> tuple[str, str, str] | None:
    """(proper name, kind, town); the town may be empty. None without any letter."""
    s = fold(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name))
    own: list[str] = []
    kind: list[str] = []
    aside: list[list[str]] = []
    for part in re.split(r"[,;]", s):
        words = re.findall(r"[^\W_]+", part)
        tokens = [t for t in words if t not in SMALL and len(t) > 2]
        if not tokens or tokens[0] in UNIT_WORDS or words[:2] == ["school", "of"]:
            continue
        kinds = [k for t in tokens if (k := nearest_kind(t))]
        rest = [t for t in tokens if not nearest_kind(t)]
        if kinds and not kind:
            kind, own = sorted(set(kinds)), rest
        elif rest:
            aside.append(rest)
    if not own and aside:
        own = aside.pop(0)
    if not own:
        return None
    return "".join(own), " ".join(kind), "".join(t for a in aside for t in a)


def organisation_check(a: tuple[str, str, str], b: tuple[str, str, str]) -> float:
    f = family_match(a[0], b[0])
    if not f or a[1] != b[1]:
        return 0.0
    if not a[2] or not b[2]:
        return 0.8 * f if f > TWO_TYPOS else WEAK
    t = family_match(a[2], b[2])
    if f * t >= 0.8:
        return f * t
    return WEAK if min(f, t) >= TWO_TYPOS and max(f, t) == 1 else 0.0


def whole_name(name: str) -> str | None:
    """All letters and digits of a name that can't be parsed; None without any letter."""
    part = re.sub(r"[\W_]", "", fold(name))
    return part if any(c.isalpha() for c in part) else None


def trigrams(s: str) -> list[str]:
    s = f"##{s}##"
    return sorted({s[i : i + 3] for i in range(len(s) - 2)})


def distinct_names(df: DataFrame, column: str) -> DataFrame:
    """(name): the different stored strings of an array column, blank ones left out."""
    return df.select(F.explode(column).alias("name")).where(F.trim(F.regexp_replace("name", r"(?U)\s+", " ")) != "").groupBy("name").agg(F.count("*").alias("n"))


def first_shares(names: DataFrame) -> DataFrame:
    """(token, share): how often a full token stands first rather than last, over names without a comma.

    One row per token that occurs in several names; the counts run over all names and stay a table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, first = [], []
            for name in b.column(0).to_pylist():
                head, tail = person_tokens(name)
                full = [t for t in head if len(t) > 2 and not t.endswith(".")]
                if tail is None and len(full) >= 2:
                    tokens += [full[0], full[-1]]
                    first += [1, 0]
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(first, pa.int32())], names=["token", "first"])

    return names.select("name").mapInArrow(run, "token string, first int").groupBy("token").agg(F.avg("first").alias("share"), F.count("*").alias("n")).where("n >= 3")


def parsed_persons(names: DataFrame, nicknames: dict[str, set[str]]) -> DataFrame:
    """(name, block, part, rest): block a possible first initial, part the family, rest the given parts."""
    shared = Shared(names.sparkSession, nicknames)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [two_full(*person_tokens(name)) for name in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], names=["name", "t1", "t2"])

    shares = cut(first_shares(names).select("token", "share"))
    order = names.select("name").mapInArrow(ends, "name string, t1 string, t2 string")
    for t, s in (("t1", "s1"), ("t2", "s2")):
        order = order.join(shares.select(F.col("token").alias(t), F.col("share").alias(s)), t, "left")
    order = order.select("name", (F.coalesce("s2", F.lit(0.0)) > F.coalesce("s1", F.lit(0.0)) + 0.3).alias("swap"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full_of = shared.get()
        for b in batches:
            out: list[tuple[str, list[str], str, list[str]]] = []
            for name, swap in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                short = {fold(t) for t in re.findall(r"\b[A-Z]{1,3}\b", name)} if not name.isupper() else set()
                p = parse_person(name, short, swap)
                if p and p[0] and p[1]:
                    x = p[1][0].rstrip(".")
                    # the second letter too: one edit at the head of a name leaves it among the first two
                    blocks = set(x[:2]) | {f[0] for f in full_of.get(x, ())}
                    out.append((name, sorted(blocks), p[0], p[1]))
                elif w := whole_name(name):
                    out.append((name, sorted({UNPARSED + c for c in w[:2]}), w, []))
            cols = list(zip(*out)) or [(), (), (), ()]
            kinds = [pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["name", "blocks", "part", "rest"])

    return order.mapInArrow(run, "name string, blocks array<string>, part string, rest array<string>")


def parsed_organisations(names: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name in b.column(0).to_pylist():
                p = parse_organisation(name)
                if p:
                    out.append((name, [p[1]], p[0], [p[1], p[2]]))
                elif w := whole_name(name):
                    out.append((name, [UNPARSED], w, [UNPARSED, ""]))
            cols = list(zip(*out)) or [(), (), (), ()]
            kinds = [pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["name", "blocks", "part", "rest"])

    return names.select("name").mapInArrow(run, "name string, blocks array<string>, part string, rest array<string>")


def in_blocks(df: DataFrame, key: list[str], by: str) -> tuple[DataFrame, DataFrame]:
    """df twice, with a column `salt`: once each row in its own block of its bucket, once each row in all of them.

    Joined on the key and salt they meet exactly once, and no task holds more than a block against a bucket.
    """
    size = df.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    both = df.join(size, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    one = both.withColumn("salt", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int")).drop("blocks")
    return one, both.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")


def cosine_pairs(parts: DataFrame, least: float = MIN_PART) -> DataFrame:
    """(block, a, b, cosine): pairs of different parts of one block whose trigram vectors reach `least`.

    parts: distinct (block, part). Prefix filtering: with features in order of falling weight, the
    suffix whose norm is below `least` cannot reach it alone, so one common feature lies in the prefix of
    either side; the dot product is then summed over full vectors of the pairs met.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [trigrams(p) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.string()))], names=["part", "grams"])

    grams = cut(parts.select("part").distinct().mapInArrow(run, "part string, grams array<string>"))
    n = grams.count()
    idf = grams.select(F.explode("grams").alias("g")).groupBy("g").agg(F.sqrt(F.log(F.lit(float(n + 1)) / F.count("*")) + 0.1).alias("w"))
    weighted = (
        grams.select("part", F.explode("grams").alias("g"))
        .join(idf, "g")
        .groupBy("part")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("m"), "g"))).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    )
    # a vector as map gram -> unit weight; a part has at most as many grams as letters
    vec = weighted.select("part", F.transform("v", lambda x: F.struct(x["g"].alias("g"), (-x["m"] / F.col("norm")).alias("w"))).alias("v"))
    left_over = F.aggregate("v", F.struct(F.lit(1.0).alias("rest"), F.array().cast("array<string>").alias("keep")), lambda s, x: F.struct(
        (s["rest"] - x["w"] * x["w"]).alias("rest"),
        F.when(s["rest"] >= least * least, F.concat(s["keep"], F.array(x["g"]))).otherwise(s["keep"]).alias("keep"),
    ))
    vec = cut(vec.withColumn("keys", left_over["keep"]))
    x, y = in_blocks(cut(parts.join(vec.select("part", F.explode("keys").alias("g")), "part").select("block", "g", "part")), ["block", "g"], "part")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("block", "g", "salt")]
    # an edit changes the length by one, so only such pairs can pass the check at all
    edit = (F.col("x.part") < F.col("y.part")) & (F.abs(F.length("x.part") - F.length("y.part")) <= MOST_EDITS)
    met = x.alias("x").join(y.alias("y"), same[0] & same[1] & same[2] & edit).select("x.block", F.col("x.part").alias("a"), F.col("y.part").alias("b")).distinct()
    full = met.join(vec.select(F.col("part").alias("a"), F.col("v").alias("va")), "a").join(vec.select(F.col("part").alias("b"), F.map_from_entries("v").alias("vb")), "b")
    dot = F.aggregate("va", F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.element_at("vb", x["g"]), F.lit(0.0)))
    return full.select("block", "a", "b", dot.alias("cosine")).where(F.col("cosine") >= least)


def features(rest: list[str], persons: bool, full_of: dict[str, set[str]]) -> tuple[set[str], set[str]]:
    """The features of a name's second and third part: initials or kind, given name or town."""
    if not rest:
        return set(), set()
    if not persons:
        return {f"k{w}" for w in rest[0].split()}, {f"t{g}" for g in trigrams(rest[1])} if rest[1] else set()
    x = rest[0].rstrip(".")
    alike = {x} | full_of.get(x, set())
    return {f"i{a[0]}" for a in alike}, {f"g{g}" for a in alike for g in trigrams(a)} if len(x) > 1 else set()


def slot(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big") % SLOTS


def frequencies(entities: DataFrame, persons: bool, nicknames: dict[str, set[str]]) -> np.ndarray:
    """Entities that have a feature, by its slot; a table of fixed size."""
    shared = Shared(entities.sparkSession, nicknames)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full_of, counts = shared.get(), np.zeros(SLOTS, np.int64)
        for b in batches:
            for rest in b.column(0).to_pylist():
                for fs in features(rest, persons, full_of):
                    for f in fs:
                        counts[slot(f)] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "n"])

    sums = entities.select("rest").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS)
    out[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    return out


class Vectors:
    """Cosines of full name vectors, given that of their first part."""

    def __init__(self, counts: np.ndarray, n: int, persons: bool, full_of: dict[str, set[str]]):
        self.weight = np.sqrt(np.log((n + 1) / np.maximum(counts, 1)) + 0.1)
        self.persons, self.full_of = persons, full_of
        self.known: dict[tuple[str, ...], tuple[dict[str, float], dict[str, float], float]] = {}

    def parts(self, rest: tuple[str, ...]) -> tuple[dict[str, float], dict[str, float], float]:
        """(second part, third part, length of the whole vector), the first part being of length 1 before its share."""
        got = self.known.get(rest)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            out, square = [], SHARES[0]
            for share, fs in zip(SHARES[1:], features(list(rest), self.persons, self.full_of)):
                w = {f: float(self.weight[slot(f)]) for f in fs}
                norm = sum(v * v for v in w.values()) ** 0.5
                out.append({f: v / norm * share**0.5 for f, v in w.items()})
                square += share if w else 0.0
            got = self.known[rest] = (out[0], out[1], square**0.5)
        return got

    def cosine(self, first: float, a: tuple[str, ...], b: tuple[str, ...]) -> float:
        x, y = self.parts(a), self.parts(b)
        dot = SHARES[0] * first + sum(w * y[i][f] for i in (0, 1) for f, w in x[i].items() if f in y[i])
        return dot / (x[2] * y[2])


def scored_links(parsed: DataFrame, persons: bool, nicknames: dict[str, set[str]]) -> DataFrame:
    """(a, b, score) with a < b of distinct entities (part, rest) encoded as keys of `parsed`."""
    spark = parsed.sparkSession
    vectors = Shared(spark, Vectors(frequencies(parsed, persons, nicknames), parsed.count(), persons, nicknames))
    blocked = cut(parsed.select(F.explode("blocks").alias("block"), "part", "key", "rest"))
    parts = blocked.select("block", "part").distinct()
    near = cosine_pairs(parts).select("block", "a", "b", "cosine")
    left = blocked.select("block", F.col("part").alias("a"), F.col("key").alias("ka"), F.col("rest").alias("ra"))
    right = blocked.select("block", F.col("part").alias("b"), F.col("key").alias("kb"), F.col("rest").alias("rb"))
    across = near.join(left, ["block", "a"]).join(right, ["block", "b"]).select("a", "b", "ka", "kb", "ra", "rb", "cosine")
    x, y = in_blocks(blocked, ["block", "part"], "key")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("block", "part", "salt")]
    within = x.alias("x").join(y.alias("y"), same[0] & same[1] & same[2] & (F.col("x.key") < F.col("y.key"))).select(F.col("x.part").alias("a"), F.col("y.part").alias("b"), F.col("x.key").alias("ka"), F.col("y.key").alias("kb"), F.col("x.rest").alias("ra"), F.col("y.rest").alias("rb"), F.lit(1.0).alias("cosine"))
    both = across.unionByName(within)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vectors.get()
        for batch in batches:
            rows: list[tuple[str, str, float]] = []
            for a, b, ka, kb, ra, rb, first in zip(*(batch.column(i).to_pylist() for i in range(7))):
                cosine = v.cosine(first, tuple(ra), tuple(rb))
                if cosine < MIN_COSINE:
                    continue
                agrees = person_check((a, ra), (b, rb), v.full_of) if persons else organisation_check((a, *ra), (b, *rb))
                if agrees:
                    rows.append((min(ka, kb), max(ka, kb), cosine if agrees > WEAK else min(cosine, WEAK)))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["a", "b", "score"])

    # a pair may meet in two blocks, always with the same cosine
    return both.mapInArrow(run, "a string, b string, score double").dropDuplicates(["a", "b"])


def average_linkage(ids: list[str], links: list[tuple[str, str, float]], least: float) -> dict[str, str]:
    """id -> cluster id (its smallest member), merging the two clusters of highest average score while it
    is at least `least`; absent pairs count as 0, ties go to the smaller ids."""
    size = dict.fromkeys(ids, 1)
    near: dict[str, dict[str, float]] = {i: {} for i in ids}
    for a, b, s in links:
        near[a][b] = near[b][a] = s
    parent = {i: i for i in ids}
    import heapq

    heap = [(-s, a, b) for a, b, s in links]
    heapq.heapify(heap)
    while heap:
        s, a, b = heapq.heappop(heap)
        if a not in near or b not in near or b not in near[a] or abs(near[a][b] / (size[a] * size[b]) + s) > 1e-12:
            continue
        if -s < least:
            break
        a, b = min(a, b), max(a, b)
        gone = near.pop(b)
        parent[b] = a
        size[a] += size.pop(b)
        near[a].pop(b, None)
        for c, v in gone.items():
            if c != a:
                near[c].pop(b, None)
                near[a][c] = near[c][a] = near[a].get(c, 0.0) + v
        for c, v in near[a].items():
            heapq.heappush(heap, (-v / (size[a] * size[c]), min(a, c), max(a, c)))

    def root(i: str) -> str:
        while parent[i] != i:
            i = parent[i]
        return i

    return {i: root(i) for i in ids}


def reciprocal_rounds(links: DataFrame, least: float) -> DataFrame:
    """(key, cluster): the same clustering by joins, for components too large for one task.

    Average linkage is reducible, so pairs that are each other's nearest may be merged at once.
    """
    e = cut(links.select("a", "b", F.col("score").alias("s")).unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("score").alias("s"))))
    owner = cut(e.select(F.col("a").alias("key")).distinct().withColumn("cluster", F.col("key")))
    while True:
        size = owner.groupBy("cluster").agg(F.count("*").cast("double").alias("n"))
        avg = e.join(size.select(F.col("cluster").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("cluster").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", (F.col("s") / F.col("na") / F.col("nb")).alias("v")).where(F.col("v") >= least)
        # ties: the pair with the smaller ids, seen alike from either end
        best = avg.groupBy("a").agg(F.min_by("b", F.struct(-F.col("v"), F.least("a", "b"), F.greatest("a", "b"))).alias("b"))
        pairs = cut(best.alias("x").join(best.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a")) & (F.col("x.a") < F.col("x.b"))).select(F.col("x.b").alias("old"), F.col("x.a").alias("new")))
        if pairs.isEmpty():
            return owner

        def moved(df: DataFrame, c: str) -> DataFrame:
            return df.join(pairs.select(F.col("old").alias(c), "new"), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")  # noqa: B023

        owner = cut(moved(owner, "cluster").select("key", "cluster"))
        e = cut(moved(moved(e, "a"), "b").where("a != b").groupBy("a", "b").agg(F.sum("s").alias("s")))


def clusters(links: DataFrame, least: float = MIN_COSINE) -> DataFrame:
    """(key, cluster) of all linked keys."""
    links = cut(links)
    comp = components(links, "a", "b")
    joined = cut(links.join(comp.select(F.col("id").alias("a"), "component"), "a"))
    sizes = joined.groupBy("component").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > MAX_LINKS).select("component")
    small = joined.join(large, "component", "left_anti")

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["a"]) | set(pdf["b"]))
        got = average_linkage(ids, sorted(zip(pdf["a"], pdf["b"], pdf["score"])), least)
        return pd.DataFrame({"key": list(got), "cluster": list(got.values())})

    # many small components per call: a group is a hash bucket of whole components
    buckets = max(1, int(np.ceil(joined.count() / 20_000)))
    out = small.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets))).groupBy("bucket").applyInPandas(lambda pdf: local(pdf), "key string, cluster string")
    if large.isEmpty():
        return out
    return out.unionByName(reciprocal_rounds(joined.join(large, "component", "left_semi"), least))


def link_variants(names: DataFrame, persons: bool, nicknames: dict[str, set[str]]) -> DataFrame:
    """(name, entity): every distinct name with its entity, the smallest key of its cluster."""
    parsed = parsed_persons(names, nicknames) if persons else parsed_organisations(names)
    parsed = cut(parsed.withColumn("key", F.concat_ws("|", "part", F.array_join("rest", " "))))
    entities = parsed.select("key", "part", "rest", "blocks").dropDuplicates(["key"])
    owner = clusters(scored_links(entities, persons, nicknames))
    return parsed.select("name", "key").join(owner, "key", "left").select("name", F.coalesce("cluster", "key").alias("entity"))


def variant_pairs(entities: DataFrame) -> DataFrame:
    """(entity, name_a, name_b), name_a < name_b in byte order: the spellings of one entity (a result of that form is asked for)."""
    x, y = in_blocks(cut(entities), ["entity"], "name")
    met = (F.col("x.entity") == F.col("y.entity")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.name") < F.col("y.name"))
    return x.alias("x").join(y.alias("y"), met).select("x.entity", F.col("x.name").alias("name_a"), F.col("y.name").alias("name_b"))


def nickname_map(df: DataFrame) -> dict[str, set[str]]:
    """nickname -> its given names; a table of the language, which doesn't grow with the data."""
    out: dict[str, set[str]] = {}
    for r in df.select("given_name", "nickname").toLocalIterator():
        if r[0] and r[1]:
            out.setdefault(fold(r[1]), set()).add(fold(r[0]))
    return out
