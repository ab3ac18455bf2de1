"""Noise of scanned pages: found by kind and repaired into continuous paragraphs.

Evidence: the number of groups of papers each word, and each hyphenated pair of words, occurs in. Equal texts,
near-equal ones (estimated Jaccard similarity of `ALIKE` at least) and versions of a paper are one group, so
copies of a noisy paper are no evidence for its errors. Hyphenation: a word
broken at a line end is rejoined when the joined word is better attested than the hyphenated pair.
Misrecognised characters: every word has an anagram hash, the sum of its characters' hashes; replacing
a string by the one it is mistaken for changes the hash by a fixed difference, so rare words meet
their frequent variants in an equi-join on hash plus difference, are verified position by position, and the
variant of highest frequency wins. Edge lines: printed page numbers by their form and surroundings, running
heads by form (authors, journal with volume, venue with year), because they repeat the paper's title, or because
they stand at `REPEATED` places of the paper's text, numbers in them aside.

How often a variant must be more frequent does not depend on the size of the collection: `RATIO` times for words of
fewer than `FEW` groups, where chance decides, and `FAR` times for others - a misreading is a small share of
its word's places, however many there are. Words of more than one group in `COMMON` that have no variant are left
out of what a scan sends on, which changes no result and bounds the broadcast lexicon by `COMMON` times the average
number of different words of a group.

Null and empty texts have no noise. Repeated rows count once per kind. Texts are taken whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.graph import components
from folioscope.llm.neardup import SYMBOLS, differing, signatures
from folioscope.llm.words import WORD
from folioscope.runtime import Shared, cut

COMMON, RATIO, FAR, FEW, REPEATED = 200, 4, 20, 5, 3
#: Estimated similarity from which two texts are one piece of evidence.
ALIKE = 0.6

#: What scans make of characters: (misread form, right form). Fixed values.
CONFUSIONS = [
    ("c", "e"), ("0", "o"), ("cl", "d"), ("1", "l"), ("ri", "n"), ("5", "s"), ("li", "h"), ("rn", "m"), ("9", "g"),
    ("d", "cl"), ("m", "rn"), ("vv", "w"), ("n", "ri"), ("h", "li"), ("1", "i"), ("8", "b"), ("6", "b"), ("11", "ll"), ("00", "oo"), ("55", "ss"), ("ii", "u"), ("w", "vv"), ("f", "t"), ("rn", "in"),
]

SIGNS = tuple("-‐‑¬\xad")
BROKEN = re.compile(r"[-‐‑¬\xad][^\S\n]*\n\s*\w+")
FIRST = re.compile(r"\s*([^\W\d_]+)")
SUSPENDING = {"and", "or", "to", "und", "oder", "et", "ou", "y", "o", "e"}
SURE_BREAK = "¬\xad"
PAIR = re.compile(r"(?=(?<![^\W\d_])([^\W\d_]+[-‐‑][^\W\d_]+))")
MARKED_PAGE = re.compile(r"[-–—·•]\s*\d+\s*[-–—·•]|p(?:age|g|\.)?\.?\s*\d+|\[\s*\d+\s*\]|\d+\s*(?:/|of)\s*\d+", re.I)
BARE_PAGE = re.compile(r"\d+")
BESIDE = (re.compile(r"\d+\s+(\S.*)"), re.compile(r"(.*\S)\s+\d+"))
HEAD = re.compile(r"[^\W\d_][\w’'.-]*(?: [^\W\d_][\w’'.-]*)? (?:et al\.?|and co-?workers)|[^.]{3,}, Vol\.? \d+(?:, (?:No|Iss)\.? \d+)?|[A-Z][A-Z-]{3,} (?:19|20)\d\d", re.I)
VENUE = re.compile(r"[A-Z][A-Z-]{3,} (?:19|20)\d\d")
CELL = re.compile(r"\S{1,14}")


def is_head(core: str) -> bool:
    return bool(HEAD.fullmatch(core)) and (VENUE.fullmatch(core) is not None or not re.fullmatch(r"[A-Za-z-]+ (?:19|20)\d\d", core))


def running(line: str) -> bool:
    return len(re.findall(r"[^\W\d_]{2,}", line)) >= 3


def broken(line: str) -> tuple[str, str] | None:
    """(first part, sign) of a word that the end of the line breaks."""
    x = line.rstrip()
    if x[-1:] not in SIGNS or not x:
        return None
    at = len(x) - 1
    while at and x[at - 1].isalpha():
        at -= 1
    return (x[at:-1], x[-1]) if at < len(x) - 1 else None


def form(line: str) -> str:
    """A line as it is compared with others: lower case, the number at either end aside."""
    return re.sub(r"^\d+ | \d+$", "", line.lower())


class Lines:
    """The lines of a text with the role of each: '' text, 'p' page number, 'h' running head,
    'b' both, '?' possibly the paper's title repeated."""

    def __init__(self, text: str, longest: int = 1 << 30):
        self.longest = longest
        self.raw = re.split(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]", text)
        self.plain = [" ".join(x.split()) for x in self.raw]
        self.role = [self._form(i) for i in range(len(self.raw))]
        for i, r in enumerate(self.role):
            if r == "#":
                self.role[i] = "p" if self._bare(i) else ""
        if len(self.raw) > 1:
            for i, r in enumerate(self.role):
                if not r and self._may_be_title(i):
                    self.role[i] = "?"

    def _form(self, i: int) -> str:
        x = self.plain[i]
        if not x or len(self.raw) == 1:
            return ""
        if MARKED_PAGE.fullmatch(x):
            return "p"
        if BARE_PAGE.fullmatch(x):
            return "#"
        if is_head(x):
            return "h"
        if (x[0].isdigit() or x[-1].isdigit()) and any(is_head(m.group(1)) for b in BESIDE if (m := b.fullmatch(x))):
            return "b"
        return ""

    def _bare(self, i: int) -> bool:
        """A bare number stands alone between blank lines, edge lines or running text, not among cells."""
        before = self.plain[i - 1] if i else ""
        after = self.plain[i + 1] if i + 1 < len(self.plain) else ""
        roles = (self.role[i - 1] if i else "", self.role[i + 1] if i + 1 < len(self.role) else "")
        for x, r in zip((before, after), roles):
            if x and r not in ("h", "p", "b") and CELL.fullmatch(x) and not (x[-1:] in ".,;)" or x.isalpha()):
                return False
            if x and r == "#":
                return False
        return True

    def _may_be_title(self, i: int) -> bool:
        x = self.plain[i]
        return 8 <= len(x) <= self.longest and " " in x and x[-1] not in ".;" and (x[0].isupper() or x[0].isdigit() or x[0] in "([")

    def breaks(self) -> Iterator[tuple[int, int, str, str, str]]:
        """(line, continuing line, first part, sign, second part) of words broken over a line end."""
        for i, x in enumerate(self.raw):
            if self.role[i] in ("p", "h", "b"):
                continue
            if not (half := broken(x)):
                continue
            j = i + 1
            while j < len(self.raw) and (not self.plain[j] or self.role[j] in ("p", "h", "b", "?")) and not (self.plain[j] and self.plain[j][0].islower()):
                j += 1
            if j < len(self.raw) and (n := FIRST.match(self.raw[j])) and n.group(1)[0].islower():
                yield i, j, half[0], half[1], n.group(1)

    def body(self) -> str:
        """The text without edge lines, broken words joined, for counting and finding words."""
        cutting = {i: j for i, j, *_ in self.breaks()}
        out = []
        for i, x in enumerate(self.raw):
            if self.role[i] in ("p", "h", "b"):
                continue
            out.append(x.rstrip()[:-1] if i in cutting else x + "\n")
            # what stands between the two halves is left out of the joined word by dropping it
        return "".join(out)


def without_breaks(text: str) -> str:
    """The text without words broken over a line end."""
    out, at = [], 0
    for m in BROKEN.finditer(text):
        s = m.start()
        while s > at and text[s - 1].isalpha():
            s -= 1
        out.append(text[at:s])
        at = m.end()
    return " ".join([*out, text[at:]])


def text_groups(papers: DataFrame, text: str = "text") -> DataFrame:
    """(id, grp): the group of every different text, by the hashes of the texts.

    Every text is compared with the smallest id of each bucket of its fingerprint only, and every version
    with the smallest of its paper, so the work is linear however large a group is.
    """
    src = papers.where(F.col(text).isNotNull()).select(F.md5(text).alias("id"), F.col("paper_id").cast("string").alias("paper"), F.col(text).alias("text"))
    fs = [f"f{i}" for i in range(SYMBOLS // 16)]
    sig = cut(signatures(src, "id", ["text"], None, 3).select("id", *fs, "keys").dropDuplicates(["id"]))
    rows = sig.select(F.explode("keys").alias("k"), "id")
    centres = rows.groupBy("k").agg(F.min("id").alias("centre"), F.count("*").alias("c")).where("c > 1").select("k", "centre")
    met = rows.join(centres, "k").where("id != centre").select("id", "centre").distinct()
    packs = sig.select("id", *fs)
    full = met.alias("m").join(packs.alias("a"), F.col("m.id") == F.col("a.id")).join(packs.alias("b"), F.col("m.centre") == F.col("b.id"))
    near = full.where(differing("a", "b") <= SYMBOLS - round(SYMBOLS * (ALIKE + (1 - ALIKE) / 16))).select("m.id", "m.centre")
    versions = src.where("paper IS NOT NULL").select("paper", "id").distinct()
    first = versions.groupBy("paper").agg(F.min("id").alias("centre"))
    same = versions.join(first, "paper").where("id != centre").select("id", "centre")
    group = components(near.unionByName(same), "id", "centre")
    return src.select("id").distinct().join(group, "id", "left").select("id", F.coalesce("component", "id").alias("grp"))


def word_evidence(papers: DataFrame, groups: DataFrame, text: str = "text") -> DataFrame:
    """(word, df): the groups of papers each word, and each hyphenated pair, occurs in; the halves of broken words don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str | None]] = Counter()

        def out() -> pa.RecordBatch:
            words, grps = zip(*counts) if counts else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(grps, pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "grp", "n"])

        for b in batches:
            for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                low = without_breaks(t.lower())
                counts.update((w, g) for w in set(WORD.findall(low)))
                counts.update({(p.replace("‐", "-").replace("‑", "-"), g) for p in PAIR.findall(low)} if "-" in low else ())
                if len(counts) > 500_000:
                    yield out()
                    counts.clear()
        yield out()

    # only texts that share their group are counted by group
    src = papers.where(F.col(text).isNotNull()).select(F.md5(text).alias("id"), F.col(text).alias("text"))
    shared = src.select("id").join(groups, "id").groupBy("grp").agg(F.count("*").alias("c")).where("c > 1").select("grp")
    own = groups.join(shared, "grp").select("id", "grp")
    found = src.join(own, "id", "left").select("text", "grp").mapInArrow(run, "word string, grp string, n bigint")
    once = found.groupBy("word", "grp").agg(F.sum("n").alias("n"))
    return once.groupBy("word").agg(F.sum(F.when(F.col("grp").isNull(), F.col("n")).otherwise(F.lit(1).cast("bigint"))).alias("df"))


def anagram(word: Column) -> Column:
    """Order-free hash: the sum of the hashes of the characters, each below 2^40."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda a, c: a + F.when(c == "", F.lit(0).cast("bigint")).otherwise(F.pmod(F.xxhash64(c), F.lit(1 << 40))))


def corrections(evidence: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(word, variant, df, variant_df): words with their best confusable variant of sufficient frequency, of all words or of those asked for."""
    spark = evidence.sparkSession
    long = (F.length("word") >= 4) & ~F.col("word").contains("-")
    usable = evidence.where(long)
    has_digit = F.col("word").rlike("[0-9]")
    letters = F.length(F.regexp_replace("word", "[^\\p{L}]", ""))
    tested = (evidence if asked is None else asked).where(long & (letters >= 3) & ~F.col("word").rlike("^[0-9]*[a-z]?$")).withColumn("hash", anagram(F.col("word")))
    good = usable.where(~has_digit & (F.col("df") >= 2)).select(F.col("word").alias("variant"), F.col("df").alias("variant_df"), anagram(F.col("word")).alias("target"))
    table = spark.createDataFrame(CONFUSIONS, "misread string, right string").select("misread", "right", (anagram(F.col("right")) - anagram(F.col("misread"))).alias("diff"))
    tried = tested.join(F.broadcast(table), F.col("word").contains(F.col("misread")))  # a fixed list of some 20 rows
    met = tried.withColumn("target", F.col("hash") + F.col("diff")).join(good, "target")
    at = F.exists(
        F.sequence(F.lit(1), F.length("word")),
        lambda i: (F.substring(F.col("word"), i, F.length("misread")) == F.col("misread"))
        & (F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.col("right"), F.substring(F.col("word"), i + F.length("misread"), F.length("word"))) == F.col("variant")),
    )
    # a digit among letters is an error for certain; a real word needs the stronger evidence
    enough = F.when(F.col("df") >= FEW, F.col("variant_df") >= FAR * F.col("df")).when(has_digit, F.col("variant_df") > F.col("df")).otherwise(F.col("variant_df") >= RATIO * F.col("df"))
    return met.where(enough & at).groupBy("word").agg(F.max_by(F.struct("variant", "variant_df"), F.struct("variant_df", "variant")).alias("v"), F.first("df").alias("df")).select("word", "v.variant", "df", "v.variant_df")


def break_verdicts(breaks: DataFrame, evidence: DataFrame) -> DataFrame:
    """(w1, w2): the pairs whose break was made by the line end, out of the distinct pairs of `breaks`."""
    pairs = breaks.select("w1", "w2").distinct().withColumns({"joined": F.concat("w1", "w2"), "pair": F.concat_ws("-", "w1", "w2")})
    for c in ("joined", "pair", "w1", "w2"):
        pairs = pairs.join(evidence.select(F.col("word").alias(c), F.col("df").alias(f"df_{c}")), c, "left")
    n = {c: F.coalesce(F.col(f"df_{c}"), F.lit(0)) for c in ("joined", "pair", "w1", "w2")}
    whole = (n["joined"] > n["pair"]) | ((n["joined"] == 0) & (n["pair"] == 0) & (n["w2"] <= 1))
    return pairs.where(whole).select("w1", "w2")


class Scan:
    """What one pass over the records finds: sure kinds, and what needs evidence."""

    def __init__(self, records: DataFrame, papers: DataFrame):
        spark = records.sparkSession
        groups = cut(text_groups(papers))
        self.evidence = cut(word_evidence(papers, groups))
        frequent_from = max(FEW, groups.select("grp").distinct().count() // COMMON)
        known = self.evidence.where(~F.col("word").contains("-"))
        known_fixes = cut(corrections(known))
        frequent = known.where(F.col("df") >= frequent_from).join(known_fixes, "word", "left_anti")
        lexicon = {r["word"] for r in frequent.select("word").toLocalIterator()}
        # no line longer than every title, with a number at either end, repeats one
        longest = 2 * (papers.agg(F.max(F.length("title"))).first()[0] or 0) + 40
        shared = Shared(spark, (lexicon, longest))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common, longest = shared.get()
            for b in batches:
                cols: list[list] = [[] for _ in range(9)]
                for table, key, paper, t in zip(*[b.column(i).to_pylist() for i in range(4)]):
                    if not t:
                        continue
                    page = head = sure = False
                    titles: list[str] = []
                    again: list[str] = []
                    pairs: set[tuple[str, str]] = set()
                    body = t
                    if "\n" in t or "\r" in t or "\x0c" in t:
                        x = Lines(t, longest)
                        page = any(r in ("p", "b") for r in x.role)
                        head = any(r in ("h", "b") for r in x.role)
                        titles = sorted({p for p, r in zip(x.plain, x.role) if r == "?"})
                        if table == "papers":
                            seen = Counter(form(p) for p, r in zip(x.plain, x.role) if r == "?")
                            again = sorted(f for f, n in seen.items() if n >= REPEATED and len(f) >= 8 and " " in f)
                        for _, _, w1, sign, w2 in x.breaks():
                            if sign in SURE_BREAK:
                                sure = True
                            else:
                                pairs.add((w1.lower(), w2.lower()))
                        body = x.body()
                    rare = [w for w in set(WORD.findall(body.lower())) - common if len(w) >= 4 and not w.isdigit()]
                    if page or head or sure or titles or pairs or rare:
                        for c, v in zip(cols, (table, key, paper, page, head, sure, titles, again, [[*p] for p in sorted(pairs)])):
                            c.append(v)
                        words_of.append(sorted(rare))
                kinds = [pa.string()] * 3 + [pa.bool_()] * 3 + [pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(cols, kinds)], pa.array(words_of, pa.list_(pa.string()))], names=NAMES)
                words_of.clear()

        words_of: list[list[str]] = []
        schema = "record_table string, record_id string, paper_id string, page boolean, head boolean, sure boolean, titles array<string>, again array<string>, pairs array<array<string>>, rare array<string>"
        self.first = cut(records.mapInArrow(run, schema))
        self.papers = papers
        key = ["record_table", "record_id"]
        rare = self.first.select(*key, F.explode("rare").alias("word"))
        # words that occur in no paper's text are as rare as can be
        seen = rare.select("word").distinct().join(self.evidence, "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("df"))
        self.fixes = known_fixes.unionByName(cut(corrections(known, seen.where("df = 0"))))
        self.chars = rare.join(self.fixes.select("word", "variant"), "word")
        breaks = self.first.select(*key, F.explode("pairs").alias("p")).select(*key, F.col("p")[0].alias("w1"), F.col("p")[1].alias("w2"))
        self.breaks = breaks.join(break_verdicts(breaks, self.evidence), ["w1", "w2"])
        lines = self.first.select(*key, "paper_id", F.explode("titles").alias("line"))
        titles = papers.where(F.col("title").isNotNull()).select("paper_id", F.trim(F.regexp_replace(F.lower("title"), r"(?U)\s+", " ")).alias("title")).distinct()
        low = F.lower("line")
        forms = F.array(low, F.regexp_replace(low, r"^\d+ ", ""), F.regexp_replace(low, r" \d+$", ""))
        fits = lambda f: (F.length(f) >= 8) & f.contains(" ") & (F.col("title").startswith(f) | F.col("title").contains(F.concat(F.lit(" "), f)))
        bare = F.regexp_replace(low, r"^\d+ | \d+$", "")
        titled = lines.join(titles, "paper_id").where(F.exists(forms, fits)).select(*key, "line", (~F.exists(F.slice(forms, 1, 1), fits)).alias("numbered"))
        repeats = self.first.where("record_table = 'papers'").select("paper_id", F.explode("again").alias("form")).distinct()
        repeated = lines.withColumn("form", bare).join(repeats, ["paper_id", "form"]).select(*key, "line", (low != F.col("form")).alias("numbered"))
        self.titles = titled.unionByName(repeated)

    def kinds(self) -> DataFrame:
        """(record_table, record_id, kind), distinct."""
        key = ["record_table", "record_id"]
        kind = lambda df, k: df.select(*key, F.lit(k).alias("kind"))
        return (
            kind(self.first.where("page"), "page_number")
            .unionByName(kind(self.first.where("head"), "header"))
            .unionByName(kind(self.first.where("sure"), "hyphen"))
            .unionByName(kind(self.breaks, "hyphen"))
            .unionByName(kind(self.chars, "chars"))
            .unionByName(kind(self.titles, "header"))
            .unionByName(kind(self.titles.where("numbered"), "page_number"))
            .distinct()
        )

    def repaired(self, records: DataFrame) -> DataFrame:
        """(record_table, record_id, text) of every record with noise or page layout, as paragraphs.

        What was decided for a record is gathered per record - bounded by its own text - and joined
        to the text once.
        """
        key = ["record_table", "record_id"]
        chars = self.chars.groupBy(*key).agg(F.collect_set(F.struct("word", "variant")).alias("fixes"))
        breaks = self.breaks.groupBy(*key).agg(F.collect_set(F.concat_ws(" ", "w1", "w2")).alias("joins"))
        titles = self.titles.groupBy(*key).agg(F.collect_set("line").alias("heads"))
        src = records.join(chars, key, "left").join(breaks, key, "left").join(titles, key, "left").select(*key, "text", "fixes", "joins", "heads")
        src = src.where(F.col("text").isNotNull() & (F.col("fixes").isNotNull() | F.col("joins").isNotNull() | F.col("heads").isNotNull() | F.col("text").rlike("[\\n\\r\\x0c]")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = []
                for t, fixes, joins, heads in zip(*[b.column(i).to_pylist() for i in range(2, 6)]):
                    texts.append(repair(t, {f["word"]: f["variant"] for f in fixes or ()}, set(joins or ()), set(heads or ())))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["record_table", "record_id", "text"])

        return src.mapInArrow(run, "record_table string, record_id string, text string").dropDuplicates(["record_table", "record_id"])


NAMES = ["record_table", "record_id", "paper_id", "page", "head", "sure", "titles", "again", "pairs", "rare"]


def like_case(old: str, new: str) -> str:
    if old.isupper() and len(old) > 1:
        return new.upper()
    return new[:1].upper() + new[1:] if old[:1].isupper() else new


def repair(text: str, fixes: dict[str, str], joins: set[str], heads: set[str]) -> str:
    """The text without edge lines and line layout; list items and table rows keep their lines."""
    x = Lines(text)
    keep = [not (r in ("p", "h", "b") or (r == "?" and p in heads)) for r, p in zip(x.role, x.plain)]
    glue = {i: (j, sign) for i, j, w1, sign, w2 in x.breaks()}
    joined = {i for i, j, w1, sign, w2 in x.breaks() if sign in SURE_BREAK or f"{w1.lower()} {w2.lower()}" in joins}
    out: list[str] = []
    end = "\n\n"
    for i, p in enumerate(x.plain):
        if not keep[i]:
            continue
        if not p:
            if end == " ":
                end = "\n\n"
            continue
        if i in glue:
            p = p[:-1] if i in joined else p[:-1] + "-"
        out.append(end if out else "")
        out.append(p)
        nxt = next((k for k in range(i + 1, len(x.plain)) if keep[k]), None)
        if i in glue:
            # a suspended hyphen ("pre- and post-treatment") keeps its blank
            end = " " if i not in joined and FIRST.match(x.raw[glue[i][0]]).group(1) in SUSPENDING else ""
            # edge lines and blanks between the halves vanish with the break
            for k in range(i + 1, glue[i][0]):
                keep[k] = False
        elif nxt is None or not x.plain[nxt]:
            end = "\n\n"
        elif running(p) and not re.match(r"(?:[-•*–]|\(?\d{1,2}[.)]|\([a-z]\))\s", x.plain[nxt]) and "|" not in p:
            end = " "
        else:
            end = "\n"
    body = "".join(out)
    if fixes:
        body = WORD.sub(lambda m: like_case(m.group(), fixes[w]) if (w := m.group().lower()) in fixes else m.group(), body)
    return body


def scan_records(objects: DataFrame, sections: DataFrame, papers: DataFrame) -> DataFrame:
    """(record_table, record_id, paper_id, text) of the three record tables."""
    parts = [("layout_objects", objects, "object_id"), ("sections", sections, "section_id"), ("papers", papers, "paper_id")]
    out = None
    for name, df, key in parts:
        p = df.where(F.col(key).isNotNull() & (F.length("text") > 0)).select(F.lit(name).alias("record_table"), F.col(key).alias("record_id"), F.col("paper_id").alias("paper_id"), "text")
        out = p if out is None else out.unionByName(p)
    return out
