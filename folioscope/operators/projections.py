"""Search texts, views and payloads: projections that drop empty parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

SKIP_HEADINGS = ("ABSTRACT", "KEYWORDS", "CONTENTS", "TABLE OF CONTENTS")
STOP_HEADINGS = ("REFERENCES", "BIBLIOGRAPHY", "ACKNOWLEDGMENTS", "ACKNOWLEDGEMENTS", "AUTHOR INFORMATION", "SUPPORTING INFORMATION")


def joined(*parts: Column | str, sep: str = " ") -> Column:
    """Parts that are not blank, in order."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.array_join(F.filter(F.array(*[F.coalesce(c, F.lit("")) for c in cols]), lambda x: F.trim(x) != ""), sep)


def type_words(counts: Column, most: int = 3) -> Column:
    """"<type> evidence" as often as the map counts it, three times at most, types in order."""
    entries = F.array_sort(F.transform(F.map_entries(counts), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    return F.array_join(F.flatten(F.transform(entries, lambda e: F.array_repeat(F.concat(F.replace(e["k"], F.lit("_"), F.lit(" ")), F.lit(" evidence")), F.least(F.lit(most), e["v"]).cast("int")))), " ")


def paper_text(title: str, abstract: str, headings: str, intro: str, keywords: str, counts: Column) -> Column:
    return joined(title, abstract, F.array_join(headings, " "), intro, F.array_join(keywords, " "), type_words(counts))


def section_text(title: str, path: str, summary: Column, text: str) -> Column:
    return joined(title, F.array_join(path, " "), summary, text)


def chunk_text(heading: str, path: Column, text: str, types: Column) -> Column:
    return joined(heading, path, text, F.array_join(F.transform(types, lambda t: F.concat(t, F.lit(" evidence"))), " "))


def evidence_text(heading: str, path: Column, text: str, html: str, kind: str, section_kind: str) -> Column:
    """Heading, path, text, markup, and the words of the evidence type and of the section's kind."""
    words = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    return joined(heading, path, text, html, joined(words(kind), words(section_kind)))


def separated_view(title: str, abstract: str) -> Column:
    """Title and abstract around a separator mark, as sentence encoders of papers take them."""
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" [SEP] "), F.coalesce(abstract, F.lit(""))))


def contents_view(title: str, text: str) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(text, F.lit("")))


def intro_summaries(papers: DataFrame, sections: DataFrame, limit: int = 1200) -> DataFrame:
    """(paper_id, intro_summary): the first section with text called abstract, else introduction, else overview, else
    the first with text, else the paper's abstract; cut to `limit`."""
    title = F.lower(F.coalesce("section_title", F.lit("")))
    kind = F.when(title.contains("abstract"), 0).when(title.contains("introduction"), 1).when(title.contains("overview"), 2).otherwise(3)
    first = sections.where(F.coalesce("text", F.lit("")) != "").groupBy("paper_id").agg(F.min_by("text", F.struct(kind, "ordinal", "section_id")).alias("first"))
    return papers.select("paper_id", "abstract").join(first, "paper_id", "left").select("paper_id", T.truncate(F.coalesce("first", "abstract", F.lit("")), limit).alias("intro_summary"))


def paper_documents(papers: DataFrame, passages: DataFrame) -> DataFrame:
    """(paper_id, document): title, abstract and full text by lines; without a text its passages in order."""
    rows = F.array_sort(F.collect_list(F.struct("page_start", "chunk_id", "text")))
    own = passages.groupBy("paper_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("passages"))
    j = papers.join(own, "paper_id", "left")
    return j.select("paper_id", joined("title", "abstract", F.coalesce(F.nullif(F.trim(F.coalesce("text", F.lit(""))), F.lit("")), "passages"), sep="\n").alias("document"))


def labelled_view(title: str, abstract: str, heading: str, text: str) -> Column:
    label = lambda name, c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.concat(F.lit(name + ": "), F.trim(F.col(c))))
    return joined(label("Title", title), label("Abstract", abstract), label("Heading", heading), text, sep="\n\n")


def heading_form(c: Column | str) -> Column:
    """Upper case, numbering and decoration aside."""
    return F.upper(T.squash(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^[\s#■▪•*]*(?:\d+(?:\.\d+)*\.?\s+)?", "")))


def usable_sections(sections: DataFrame, least: int = 40) -> DataFrame:
    """Sections that are no front or back matter and have at least `least` characters."""
    h = heading_form("section_title")
    stop = F.lit(False)
    for s in STOP_HEADINGS:
        stop = stop | h.startswith(s)
    return sections.where(F.coalesce(~(h.isin(*SKIP_HEADINGS) | stop), F.lit(True)) & (F.length(T.squash(F.coalesce("text", F.lit("")))) >= least))


def benchmark_passages(chunks: DataFrame, papers: DataFrame, least: int = 80) -> DataFrame:
    """(paper_id, passage_id, passage_rank, passage_text) of known papers, in page order."""
    h = heading_form("heading")
    ok = chunks.where((F.length(T.squash(F.coalesce("text", F.lit("")))) >= least) & F.coalesce(~h.isin(*SKIP_HEADINGS, *STOP_HEADINGS), F.lit(True))).join(papers.select("paper_id").distinct(), "paper_id", "left_semi")
    w = Window.partitionBy("paper_id").orderBy("page_start", "chunk_id")
    return ok.select("paper_id", F.col("chunk_id").alias("passage_id"), F.row_number().over(w).alias("passage_rank"), joined("heading", "text", sep="\n").alias("passage_text"))


def abstracts(papers: DataFrame, sections: DataFrame, least_words: int = 20) -> DataFrame:
    """(paper_id, abstract, abstract_source): the record's own abstract, a section called abstract, one given
    inline, the introduction, or the first 2000 characters of the text."""
    words = lambda c: F.size(F.filter(F.split(c, " "), lambda w: w != ""))
    body = T.squash(F.coalesce("text", F.lit("")))
    inline = T.squash(F.regexp_extract(body, r"(?i)\babstract\b\s*[:.—-]+\s*(.{40,3000}?)(?:\b(?:introduction|keywords)\b|$)", 1))
    s = sections.select("paper_id", "ordinal", body.alias("b"), inline.alias("i"), heading_form("section_title").alias("h")).where("b <> ''")
    hit = F.when(F.col("h").contains("ABSTRACT"), F.struct(F.col("b").alias("t"), F.lit("section.abstract").alias("src"))).when(words(F.col("i")) >= least_words, F.struct(F.col("i").alias("t"), F.lit("section.inline_abstract").alias("src")))
    first = s.withColumn("hit", hit).where(F.col("hit").isNotNull()).groupBy("paper_id").agg(F.min_by("hit", "ordinal").alias("hit"))
    intro = s.where(F.col("h").contains("INTRODUCTION")).groupBy("paper_id").agg(F.min_by("b", "ordinal").alias("intro"))
    own = T.squash(F.coalesce("abstract", F.lit("")))
    j = papers.select("paper_id", own.alias("own"), F.substring(T.squash(F.coalesce("text", F.lit(""))), 1, 2000).alias("head")).join(first, "paper_id", "left").join(intro, "paper_id", "left")
    cut = T.truncate("intro", 1200)
    picked = (
        F.when(words(F.col("own")) >= least_words, F.struct(F.col("own").alias("t"), F.lit("paper_record.abstract").alias("src")))
        .when(F.col("hit").isNotNull(), F.struct(F.col("hit.t").alias("t"), F.col("hit.src").alias("src")))
        .when(words(F.coalesce(cut, F.lit(""))) >= least_words, F.struct(cut.alias("t"), F.lit("paper_record.intro_summary").alias("src")))
        .otherwise(F.struct(F.col("head").alias("t"), F.lit("paper_record.text_prefix").alias("src")))
    )
    return j.select("paper_id", picked["t"].alias("abstract"), picked["src"].alias("abstract_source"))


def hypothesis_query(question: str, objects: str, constraints: str, focus: str) -> Column:
    label = lambda name, c: F.when(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0, F.concat(F.lit(name + ": "), F.array_join(c, ", ")))
    return joined(F.trim(question), label("Target objects", objects), label("Required constraints", constraints), label("Disambiguation focus", focus), sep="\n")


def payload(*cols: str) -> Column:
    """A request or response body as JSON; nulls are kept."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def viewer_blocks(sections: DataFrame, objects: DataFrame) -> DataFrame:
    """(paper_id, position, kind, ref, text): headings interleaved with their objects in order, objects without a
    section last."""
    s = sections.select("paper_id", F.col("ordinal").alias("s"), F.lit(-1).alias("o"), F.lit("heading").alias("kind"), F.col("section_id").alias("ref"), F.col("section_title").alias("text"))
    home = sections.select("section_id", F.col("ordinal").alias("s"))
    o = objects.join(home, "section_id", "left").select("paper_id", F.coalesce("s", F.lit(1 << 30)).alias("s"), F.col("ordinal").alias("o"), F.col("object_type").alias("kind"), F.col("object_id").alias("ref"), "text")
    w = Window.partitionBy("paper_id").orderBy("s", "o", "ref")
    return s.unionByName(o).withColumn("position", F.row_number().over(w)).select("paper_id", "position", "kind", "ref", "text")


def library_rows(papers: DataFrame, stats: DataFrame, failures: DataFrame) -> DataFrame:
    """(paper_id, title, year, venue, pages, figures, status): indexed papers, and failed ones that are not indexed."""
    ready = papers.where(F.col("text").isNotNull()).join(stats, "paper_id", "left")
    rows = ready.select("paper_id", F.coalesce(F.nullif(T.squash("title"), F.lit("")), "paper_id").alias("title"), "year", F.upper("venue").alias("venue"), "pages", "figures", F.lit("ready").alias("status"))
    lost = failures.join(ready.select("paper_id"), "paper_id", "left_anti").select("paper_id").distinct()
    return rows.unionByName(lost.select("paper_id", F.col("paper_id").alias("title"), F.lit("failed").alias("status")), allowMissingColumns=True)


def listing_order(c: str) -> list[Column]:
    """Sort keys of ids: by prefix, then numeric tails before others, numerically."""
    tail = F.regexp_extract(c, r"([^.-]*)$", 1)
    number = tail.try_cast("bigint")
    return [F.regexp_replace(c, r"[^.-]*$", "").asc(), number.isNull().asc(), number.asc(), F.col(c).asc()]


def release_order() -> list[Column]:
    """Venue, year, the track "all" last, track."""
    return [F.col("venue").asc(), F.col("year").asc(), (F.col("track") == "all").asc(), F.col("track").asc()]


def front_matter_blocks(objects: DataFrame, authors: DataFrame, limit: int = 8) -> DataFrame:
    """(paper_id, object_id, score, rank): blocks of page 1 that may hold authors: +3 a name, +1.5 an e-mail,
    +1 an affiliation cue, -2 when long; best by position then score. authors: (paper_id, author)."""
    t = F.lower(T.squash(F.coalesce("text", F.lit(""))))
    first = objects.where((F.col("page_idx") == 1) & (F.length(t) > 0)).select("paper_id", "object_id", t.alias("t"), F.coalesce(F.try_element_at("bbox", F.lit(2)), F.lit(0.0)).alias("y"), F.coalesce(F.try_element_at("bbox", F.lit(1)), F.lit(0.0)).alias("x"))
    named = first.join(authors.select("paper_id", F.lower(T.squash("author")).alias("a")).where("a <> ''"), "paper_id").where(F.col("t").contains(F.col("a"))).groupBy("paper_id", "object_id").agg(F.countDistinct("a").alias("names"))
    j = first.join(named, ["paper_id", "object_id"], "left").withColumn("names", F.coalesce("names", F.lit(0)))
    cue = F.col("t").rlike("universit|institute|department|laborator|school|academy|college|centre|center")
    score = F.when(F.col("names") > 0, 3.0).otherwise(0.0) + F.when(F.col("t").contains("@"), 1.5).otherwise(0.0) + F.when(cue, 1.0).otherwise(0.0) - F.when(F.length("t") > 600, 2.0).otherwise(0.0)
    w = Window.partitionBy("paper_id").orderBy("y", "x", F.desc("score"), "object_id")
    return j.withColumn("score", score).where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("paper_id", "object_id", "score", "rank")


def author_markers(c: Column | str) -> Column:
    """array<struct<name, markers>> of an author line whose names carry digits or symbols."""
    parts = F.split(F.col(c) if isinstance(c, str) else c, r"\s*,\s*(?=\p{Lu})|\s+and\s+")
    one = lambda p: F.struct(
        T.squash(F.regexp_replace(p, r"[\d*†‡§¶,]+\s*$", "")).alias("name"),
        F.filter(F.split(F.regexp_replace(F.regexp_extract(p, r"([\d*†‡§¶,]+)\s*$", 1), r"(?<=[^,])(?=[*†‡§¶])", ","), ","), lambda m: m != "").alias("markers"),
    )
    return F.filter(F.transform(parts, one), lambda s: s["name"] != "")


def affiliations_of(authors: DataFrame, affiliations: DataFrame, by: str) -> DataFrame:
    """(by, name, affiliations): markers joined; an only affiliation is everyone's."""
    m = authors.select(by, "name", F.explode_outer("markers").alias("marker"))
    hit = m.join(affiliations, [by, "marker"], "left").groupBy(by, "name").agg(F.array_sort(F.collect_set("affiliation")).alias("affiliations"))
    only = affiliations.groupBy(by).agg(F.countDistinct("affiliation").alias("n"), F.first("affiliation").alias("only"))
    j = hit.join(only, by, "left")
    return j.select(by, "name", F.when((F.size("affiliations") == 0) & (F.col("n") == 1), F.array("only")).otherwise(F.col("affiliations")).alias("affiliations"))
