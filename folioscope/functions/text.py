"""Text functions as column expressions: everything here stays in whole-stage code generation.

Null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, the stop words, evidence cues and section priors that scores depend on.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "into", "is", "it",
    "of", "on", "or", "that", "the", "their", "this", "to", "using", "via", "what", "which", "with",
]
EVIDENCE_CUES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "experiment": (
        ("experiment", "evaluation", "setup", "benchmark", "dataset"),
        ("we evaluate", "we evaluated", "experiments", "evaluation", "benchmark", "dataset", "test set"),
    ),
    "result": (
        ("result", "results", "analysis"),
        ("results", "performance", "score", "scores", "accuracy", "f1", "bleu", "wins", "improves", "table"),
    ),
    "comparison": (
        ("comparison", "baseline", "ablation"),
        ("compare", "compared", "comparison", "baseline", "versus", "vs", "ablation"),
    ),
    "limitation": (
        ("limitation", "limitations", "discussion", "future work"),
        ("limitation", "limitations", "future work", "failure case", "fails on", "challenge", "weakness"),
    ),
    "appendix": (("appendix", "supplementary"), ("appendix", "supplementary")),
    "efficiency": (
        ("efficiency", "analysis", "results"),
        ("latency", "speed", "runtime", "throughput", "efficiency", "cost", "memory", "flops", "parameter"),
    ),
    "human_eval": (
        ("human evaluation", "evaluation", "analysis"),
        ("human evaluation", "human eval", "human judges", "annotators", "preference study", "user study"),
    ),
    "error_analysis": (
        ("error analysis", "analysis", "discussion"),
        ("error analysis", "failure case", "qualitative analysis", "case study", "errors"),
    ),
    "prompt_template": (
        ("appendix", "prompt", "implementation"),
        ("prompt template", "prompts", "instruction template", "system prompt", "template is shown"),
    ),
}
SECTION_PRIORS = {
    "method": ("method", "approach", "architecture", "model", "system", "framework"),
    "experiment": ("experiment", "evaluation", "results", "analysis", "dataset", "benchmark"),
    "limitation": ("limitation", "limitations", "discussion", "conclusion", "future"),
    "training": ("training", "optimization", "implementation", "appendix", "hyperparameter"),
    "baseline": ("baseline", "comparison", "ablation", "results", "evaluation"),
}
PRIOR_CUES = {
    "method": ("method", "approach", "architecture", "algorithm", "framework"),
    "experiment": ("experiment", "evaluation", "dataset", "result", "benchmark", "baseline", "ablation"),
    "limitation": ("limitation", "weakness", "failure", "future work", "discussion"),
    "training": ("train", "optimization", "hyperparameter", "implementation"),
    "baseline": ("compare", "baseline"),
}


def squash(c: Column | str) -> Column:
    """White space runs (Unicode) as single blanks, ends trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def no_blanks(a: Column) -> Column:
    return F.filter(a, lambda x: x != "")


def tokens(c: Column | str) -> Column:
    """Lower case, ASCII punctuation as blanks, split, stop words out; repeated tokens stay; null gives []."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    plain = F.translate(F.lower(c), PUNCTUATION, " " * len(PUNCTUATION))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(F.split(plain, r"(?U)\s+"), lambda x: (x != "") & ~F.array_contains(stop, x))


def ascii_tokens(c: Column | str) -> Column:
    """Runs of ASCII letters and digits in lower case, no stop words; null gives []."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return no_blanks(F.split(F.lower(c), "[^a-z0-9]+"))


def truncate(c: Column | str, limit: int = 320) -> Column:
    """At most `limit` characters; a cut text ends in "..." after trailing white space is dropped."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, limit - 3), r"(?U)\s+$", ""), F.lit("...")))


def match_text(c: Column | str) -> Column:
    """Text for whole-token containment: hyphens as blanks, tokens joined by single blanks."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(tokens(F.replace(c, F.lit("-"), F.lit(" "))), " ")


def contains_phrase(haystack: Column, needle: Column) -> Column:
    """Whole-token containment of two match_text() columns; an empty needle is in nothing."""
    blank = F.lit(" ")
    return (needle != "") & F.concat(blank, haystack, blank).contains(F.concat(blank, needle, blank))


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """prefix_ and 16 hex digits of the SHA-1 of the parts joined by ':' (nulls as empty)."""
    key = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(key), 1, 16))


def heading_level(c: Column | str) -> Column:
    """1-4 by the depth of the leading number; appendices 1, "A. " 2, everything else 1."""
    h = squash(c)
    number = F.regexp_extract(h, r"(?i)^(?:section\s+)?(\d+(?:\.\d+)*)\s+", 1)
    depth = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1
    return F.when(number != "", F.least(F.lit(4), depth)).when(h.rlike(r"(?i)^(appendix|appendices)\b"), 1).when(h.rlike(r"^[A-Z]\.\s+"), 2).otherwise(1).cast("int")


def is_reference_heading(c: Column | str) -> Column:
    h = squash(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\d+(?:\.\d+)*\s*", ""))
    return h.rlike(r"(?i)^(?:acknowledge?ments?\s+and\s+)?(?:references?|bibliography|works cited)(?:\s+and\s+.*)?$")


def is_appendix(title: Column | str, path: Column | str) -> Column:
    t = F.concat_ws(" ", F.col(title) if isinstance(title, str) else title, F.col(path) if isinstance(path, str) else path)
    return t.rlike(r"(?i)\b(appendix|appendices|supplementary)\b")


def block_type(c: Column | str) -> Column:
    return F.replace(F.lower(squash(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))), F.lit(" "), F.lit("_"))


def slug(c: Column | str, limit: int = 80) -> Column:
    """Lower case letters and digits joined by hyphens, at most `limit` characters; "item" when nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, limit), "-+$", "")
    return F.when(s == "", "item").otherwise(s)


def title_from_path(c: Column | str) -> Column:
    """File stem with underscores and hyphens as blanks."""
    stem = F.regexp_replace(F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return squash(F.regexp_replace(stem, "[_-]+", " "))


def dehyphenate(c: Column | str) -> Column:
    """Words broken by a hyphen at a line end joined, soft hyphens dropped."""
    c = F.replace(F.col(c) if isinstance(c, str) else c, F.lit("­"), F.lit(""))
    return F.regexp_replace(c, r"(\p{L})-[ \t]*\r?\n[ \t]*(\p{Ll})", "$1$2")


def bibtex_escape(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    for a, b in (("\\", r"\textbackslash{}"), ("{", r"\{"), ("}", r"\}")):
        c = F.replace(c, F.lit(a), F.lit("\x00" if a == "\\" else b))
    return F.replace(c, F.lit("\x00"), F.lit(r"\textbackslash{}"))


def reference_year(c: Column | str) -> Column:
    y = F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"\b((?:19|20)\d{2})[a-z]?\b", 1)
    return F.when(y != "", y.cast("int"))


def reference_doi(c: Column | str) -> Column:
    d = F.rtrim(F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"(?i)\b10\.\d{4,9}/[^\s\"<>]+", 0), F.lit(".,;)"))
    return F.when(d != "", d)


def reference_arxiv(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    a = F.regexp_extract(c, r"(?i)arxiv\s*:?\s*(\d{4}\.\d{4,5})(?:v\d+)?", 1)
    b = F.regexp_extract(c, r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})", 1)
    return F.when(a != "", a).when(b != "", b)


def reference_url(c: Column | str) -> Column:
    u = F.rtrim(F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"https?://[^\s\"<>]+", 0), F.lit(".,);"))
    return F.when(u != "", u)


def reference_entries(markdown: Column | str) -> Column:
    """array<string> of the blocks of the reference section, at least 20 characters each.

    A block without a year is continued by the next one.
    """
    text = F.col(markdown) if isinstance(markdown, str) else markdown
    section = F.regexp_extract(text, r"(?ims)^#{0,6}[ \t]*(?:\d+(?:\.\d+)*[ \t]+)?(?:references?|bibliography|works cited)[ \t]*$\s*(.*)", 1)
    section = F.regexp_replace(section, r"(?ms)^#{1,6}[ \t]+\S.*", "")
    blocks = F.filter(F.transform(F.split(section, r"\n[^\S\n]*\n+"), squash), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def fold(acc: Column, x: Column) -> Column:
        closed = acc["open"].rlike(r"\b(19|20)\d{2}[a-z]?\b")
        return F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), x.alias("open"))).when(
            closed, F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), x.alias("open"))
        ).otherwise(F.struct(acc["done"].alias("done"), F.concat_ws(" ", acc["open"], x).alias("open")))

    return F.filter(F.aggregate(blocks, start, fold, lambda a: F.concat(a["done"], F.array(a["open"]))), lambda x: F.length(x) >= 20)


def sentences(c: Column | str) -> Column:
    """Sentences of the squashed text, cut after . ! ? before white space."""
    return no_blanks(F.transform(F.split(squash(c), r"(?<=[.!?])\s+"), lambda s: F.trim(s)))


def main_reason(c: Column | str) -> Column:
    return F.try_element_at(sentences(c), F.lit(1))


def matching_points(c: Column | str) -> Column:
    """Up to three different sentences after the first that do not repeat it."""
    s = sentences(c)
    return F.array_distinct(F.filter(F.slice(s, 2, 3), lambda x: F.lower(x) != F.lower(F.try_element_at(s, F.lit(1)))))


def list_items(c: Column | str) -> Column:
    """Items of a list text by its markers, else by "; " when there are at least two parts, else []."""
    s = squash(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    marker = r"(?:^|(?<=\s))(?=(?:[-•*–]|\(?\d{1,3}[.)]|\([a-z]\))\s+\S)"
    by_marker = no_blanks(F.transform(F.split(s, marker), lambda x: F.trim(x)))
    by_marker = F.filter(by_marker, lambda x: x.rlike(r"^(?:[-•*–]|\(?\d{1,3}[.)]|\([a-z]\))\s+\S"))
    by_semicolon = no_blanks(F.transform(F.split(s, "; "), lambda x: F.trim(x)))
    return F.when(F.size(by_marker) > 0, by_marker).when(F.size(by_semicolon) >= 2, by_semicolon).otherwise(F.array().cast("array<string>"))


def evidence_scores(heading: Column | str, path: Column | str, text: Column | str) -> Column:
    """map<string, double>: .55 for a cue in the heading, .15 for each cue in the text up to .45, at most 1,
    an appendix at least .9; substring tests; types that score nothing are absent."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    head = F.lower(squash(F.concat_ws(" ", as_col(heading), as_col(path))))
    body = F.lower(squash(F.coalesce(as_col(text), F.lit(""))))

    def scored(x: Column) -> Column:
        entries = []
        for name, (in_heading, in_text) in EVIDENCE_CUES.items():
            hit = F.lit(False)
            for cue in in_heading:
                hit = hit | x["h"].contains(cue)
            n = sum((x["b"].contains(cue).cast("int") for cue in in_text), F.lit(0))
            score = F.when(hit, 0.55).otherwise(0.0) + F.least(F.lit(0.45), n * 0.15)
            if name == "appendix":
                score = F.when(x["h"].contains("appendix") | x["h"].contains("supplementary"), F.greatest(score, F.lit(0.9))).otherwise(score)
            entries.append(F.struct(F.lit(name).alias("k"), F.round(F.least(score, F.lit(1.0)), 4).alias("v")))
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"] > 0))

    # bound to a lambda variable, so that a text is squashed and lowered once and not once a cue
    return F.element_at(F.transform(F.array(F.struct(head.alias("h"), body.alias("b"))), scored), 1)


def evidence_types(scores: Column | str, threshold: float = 0.35) -> Column:
    """Types at or above the threshold, highest score first, the rules' order on ties."""
    scores = F.col(scores) if isinstance(scores, str) else scores
    order = F.array(*[F.lit(k) for k in EVIDENCE_CUES])
    kept = F.filter(F.map_entries(scores), lambda e: e["value"] >= threshold)
    ranked = F.array_sort(F.transform(kept, lambda e: F.struct((-e["value"]).alias("s"), F.array_position(order, e["key"]).alias("o"), e["key"].alias("k"))))
    return F.transform(ranked, lambda e: e["k"])


def section_priors(c: Column | str) -> Column:
    """Labels of the section kinds a question asks for, by substring cues."""
    low = F.lower(F.col(c) if isinstance(c, str) else c)
    found = []
    for label, cues in PRIOR_CUES.items():
        hit = F.lit(False)
        for cue in cues:
            hit = hit | low.contains(cue)
        found.append(F.when(hit, F.lit(label)))
    return F.array_compact(F.array(*found))


def expand_priors(labels: Column | str) -> Column:
    """The heading words of the labels, in order, without repeats; unknown labels stand for themselves."""
    known = F.create_map(*[x for k, v in SECTION_PRIORS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    labels = F.col(labels) if isinstance(labels, str) else labels
    return F.array_distinct(F.flatten(F.transform(labels, lambda x: F.coalesce(F.try_element_at(known, x), F.array(F.lower(x))))))


def track_of(c: Column | str) -> Column:
    """Canonical track of a name or volume id: long, short, demo; main counts as long; else as it stands."""
    t = F.lower(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))
    last = F.regexp_extract(t, r"([^-.]*)$", 1)
    return F.when(last.isin("main", "long"), "long").when(last.startswith("short"), "short").when(last.startswith("demo"), "demo").when(last == "", "unknown").otherwise(last)


def corpus_key(venue: Column | str, year: Column | str, track: Column | str) -> Column:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.concat_ws("/", F.lower(F.coalesce(as_col(venue), F.lit(""))), as_col(year).cast("string"), F.lower(F.coalesce(as_col(track), F.lit("unknown"))))


def constraint_term(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(squash(c), r"^[\s\"'`.,;:()\[\]{}]+|[\s\"'`.,;:()\[\]{}]+$", ""))


def is_entity(c: Column | str, control: list[str] = ()) -> Column:
    """A term that may name an entity: not blank, no stop or control word, no number."""
    t = constraint_term(c)
    return (t != "") & ~t.isin([*STOPWORDS, *control]) & ~t.rlike(r"^\d+$")


def duration(seconds: Column | str) -> Column:
    """"1h 02m 03s", "2m 03s" or "3s"; negative and null give "-"."""
    s = F.floor(F.col(seconds) if isinstance(seconds, str) else seconds).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(s.isNull() | (s < 0), "-").when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r)).when(m > 0, F.format_string("%dm %02ds", m, r)).otherwise(F.format_string("%ds", r))


def html_text(c: Column | str) -> Column:
    """Tags as blanks, the usual entities decoded, white space squashed."""
    t = F.regexp_replace(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return squash(t)


def page_title(html: Column | str) -> Column:
    """citation_title, og:title, then <title>, first that is not blank."""
    h = F.col(html) if isinstance(html, str) else html
    found = [
        F.regexp_extract(h, r'(?is)<meta\s+name="citation_title"\s+content="([^"]*)"', 1),
        F.regexp_extract(h, r'(?is)<meta\s+property="og:title"\s+content="([^"]*)"', 1),
        F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1),
    ]
    return F.coalesce(*[F.nullif(html_text(f), F.lit("")) for f in found])


#: Openings of captions and images, lines and paragraphs that are publishers' matter, furniture in headings.
CAPTION_LINE = r"^(?:Figure|FIGURE|Table|TABLE|Scheme|SCHEME)\s+S?\d+\b"
IMAGE_LINE = r"^!\[\]\("
DROPPED_LINES = ("Cite This:", "Complete contact information is available at:")
METADATA_LINE = r"(?i)^(?:Received:|Accepted:|Published online:|Published:|Available online:|DOI:|https?://|www\.)"
METADATA_OPENINGS = ("©", "Open Access")
NOISE_PHRASES = ("conference on", "association for computational linguistics", "proceedings of", "arxiv:", "copyright")
#: Stages of a search in order.
STAGES = ("loading_index", "planning_query", "candidate_generation", "section_narrowing", "evidence_assembly", "final_verifier", "saving_trace")


def joined_lines(c: Column | str) -> Column:
    """Soft hyphens out, words broken by a hyphen and white space rejoined, single blanks."""
    c = F.col(c) if isinstance(c, str) else c
    return squash(F.regexp_replace(F.replace(c, F.lit("­"), F.lit("")), r"([A-Za-z])-\s+([A-Za-z])", "$1$2"))


def body_line(c: Column | str) -> Column:
    """A line of running text; empty for images, captions and pointers to the publisher."""
    x = F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    out = x.rlike(IMAGE_LINE) | x.rlike(CAPTION_LINE)
    for opening in DROPPED_LINES:
        out = out | x.startswith(opening)
    return F.when(out, "").otherwise(joined_lines(x))


def is_metadata_paragraph(c: Column | str) -> Column:
    """Dates, addresses, licences, and lists of names with numbers and no sentence; an empty text is one."""
    x = joined_lines(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    words = F.size(no_blanks(F.split(x, " ")))
    commas = F.length(x) - F.length(F.replace(x, F.lit(","), F.lit("")))
    digit, stop = x.rlike("[0-9]"), x.contains(".")
    opening = F.lit(False)
    for o in METADATA_OPENINGS:
        opening = opening | x.startswith(o)
    return (x == "") | x.rlike(METADATA_LINE) | opening | (~stop & ((digit & (words < 40)) | (x.contains("&") & (words < 50)) | (digit & (commas >= 5))))


def is_document_title(c: Column | str) -> Column:
    """Whether a first heading may be the title of the whole document: no numbered, standard or publisher's heading."""
    x = squash(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    low = F.lower(x)
    no = (x == "") | low.isin("abstract", "keywords") | is_reference_heading(x) | x.rlike(r"(?i)^(?:section\s+)?\d+(?:\.\d+)*\s+") | low.rlike(r"^(?:appendix|appendices|acknowledg?ements?|introduction|conclusion|related work)\b")
    for phrase in NOISE_PHRASES:
        no = no | low.contains(phrase)
    return ~no


def without_contained(values: Column | str) -> Column:
    """The different strings of an array that are in no other one of it, letter case aside, in order."""
    v = F.array_distinct(F.filter(F.transform(F.col(values) if isinstance(values, str) else values, squash), lambda x: F.coalesce(x, F.lit("")) != ""))
    return F.filter(v, lambda x: ~F.exists(v, lambda y: (F.lower(x) != F.lower(y)) & F.lower(y).contains(F.lower(x))))


def present_fields(fields: dict[str, Column | str]) -> Column:
    """Names of the fields that are not blank, in order."""
    return F.array_compact(F.array(*[F.when(F.trim(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))) != "", F.lit(n)) for n, c in fields.items()]))


def overall_progress(stage: Column | str, done: Column | str, total: Column | str) -> Column:
    """Share of a whole search that is done: stages before this one and the part of it; "completed" is 1, others 0."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    place = F.array_position(F.array(*[F.lit(x) for x in STAGES]), as_col(stage))
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.when(as_col(total) > 0, as_col(done) / as_col(total)), F.lit(0.0))))
    return F.when(as_col(stage) == "completed", 1.0).when(F.coalesce(place, F.lit(0)) > 0, (place - 1 + part) / len(STAGES)).otherwise(0.0)
