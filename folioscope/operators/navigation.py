"""From evidence to places in a document: blocks of the text view, rectangles on pages, aliases, viewer filters.

Null and blank ids name nothing; repeated ids count once, in their first place; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

NO_STRINGS = "array<string>"
TABLE_TAGS = ("<table", "<tr", "<td", "<th", "</table", "</tr", "</td", "</th")


def lookup_key(c: Column | str) -> Column:
    """Letters and digits of ASCII in lower case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(T.squash(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "")


def title_sections(sections: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, section_id): sections that, or the head of whose path, repeat the paper's title."""
    p = papers.select("paper_id", lookup_key("title").alias("_title")).where("_title <> ''").distinct()
    path = F.filter(F.coalesce("section_path", F.array().cast(NO_STRINGS)), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    s = sections.where(F.trim(F.coalesce("section_id", F.lit(""))) != "").select("paper_id", "section_id", lookup_key("section_title").alias("_own"), lookup_key(F.try_element_at(path, F.lit(1))).alias("_head"))
    return s.join(p, "paper_id").where((F.col("_own") == F.col("_title")) | (F.col("_head") == F.col("_title"))).select("paper_id", "section_id").distinct()


def evidence_specs(units: DataFrame) -> DataFrame:
    """(paper_id, evidence_id, section_id, object_ids) with trimmed ids; blank sections are null, blank objects left out."""
    clean = F.filter(F.transform(F.coalesce("object_ids", F.array().cast(NO_STRINGS)), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    ok = units.where((F.trim(F.coalesce("paper_id", F.lit(""))) != "") & (F.trim(F.coalesce("evidence_id", F.lit(""))) != ""))
    return ok.select(F.trim("paper_id").alias("paper_id"), F.trim("evidence_id").alias("evidence_id"), F.nullif(F.trim("section_id"), F.lit("")).alias("section_id"), clean.alias("object_ids"))


def specs_by_paper(specs: DataFrame) -> DataFrame:
    """(paper_id, specs): the evidence of one paper in the order of its ids."""
    return specs.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "section_id", "object_ids"))).alias("specs"))


def markdown_targets(specs: DataFrame, sections: DataFrame, objects: DataFrame) -> DataFrame:
    """(evidence_id, block_id, section_block_id): the block of the first object that has one, else the section's;
    evidence without either is left out.

    Block ids are "section:" and "object:" with the record's id; equations have no block of their own.
    """
    sec = sections.select("section_id", F.concat(F.lit("section:"), "section_id").alias("section_block_id")).distinct()
    obj = objects.where(F.coalesce("object_type", F.lit("")) != "equation_block").select("object_id", F.concat(F.lit("object:"), "object_id").alias("_block")).distinct()
    first = specs.select("evidence_id", F.posexplode("object_ids").alias("_pos", "object_id")).join(obj, "object_id").groupBy("evidence_id").agg(F.min_by("_block", "_pos").alias("_block"))
    j = specs.select("evidence_id", "section_id").dropDuplicates(["evidence_id"]).join(first, "evidence_id", "left").join(sec, "section_id", "left")
    return j.select("evidence_id", F.coalesce("_block", "section_block_id").alias("block_id"), "section_block_id").where("block_id IS NOT NULL")


def page_sizes(pages: DataFrame, doc: str) -> DataFrame:
    """(doc, page, width, height) of pages with a size; documents whose pages count from 0 are moved to count from 1.

    pages: (doc, page_idx, width, height)."""
    known = pages.where(F.col("page_idx").isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull())
    shift = F.when(F.min("page_idx").over(Window.partitionBy(doc)) == 0, 1).otherwise(0)
    return known.withColumn("page", F.col("page_idx") + shift).where("width > 0 AND height > 0").groupBy(doc, "page").agg(F.max_by(F.struct("width", "height"), "page_idx").alias("_s")).select(doc, "page", "_s.width", "_s.height")


def page_rectangles(specs: DataFrame, objects: DataFrame, sizes: DataFrame) -> DataFrame:
    """(evidence_id, page, width, height, boxes, is_primary): the rectangles of an evidence's objects by page, in the order
    they are named; the first page is the primary one.

    A page without a size but whose follower has one is taken for a count from 0. Objects without a box of
    four numbers, pages below 1 and pages of unknown size are left out.
    """
    o = objects.where(F.size("bbox") >= 4).select("object_id", "page_idx", F.slice("bbox", 1, 4).alias("box"))
    o = o.where(F.size(F.array_compact("box")) == 4).dropDuplicates(["object_id"])
    named = specs.select("evidence_id", "paper_id", F.posexplode(F.array_distinct("object_ids")).alias("pos", "object_id")).join(o, "object_id")
    here = sizes.select("paper_id", F.col("page").alias("_p"), F.lit(True).alias("_here"))
    after = sizes.select("paper_id", (F.col("page") - 1).alias("_p"), F.lit(True).alias("_after"))
    placed = named.withColumn("_p", F.col("page_idx")).join(here, ["paper_id", "_p"], "left").join(after, ["paper_id", "_p"], "left")
    page = F.when(F.col("_here").isNull() & F.col("_after"), F.col("_p") + 1).otherwise(F.col("_p"))
    by_page = placed.withColumn("page", page).where("page > 0").groupBy("evidence_id", "paper_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "box"))), lambda x: x["box"]).alias("boxes"))
    w = Window.partitionBy("evidence_id")
    return by_page.join(sizes, ["paper_id", "page"]).withColumn("is_primary", F.col("page") == F.min("page").over(w)).select("evidence_id", "page", "width", "height", "boxes", "is_primary")


def object_aliases(units: DataFrame) -> DataFrame:
    """(object_id, evidence_ids): the evidence that names an object, in the order of its ids."""
    x = units.where(F.col("evidence_id").isNotNull()).select("evidence_id", F.explode("object_ids").alias("object_id"))
    return x.where(F.col("object_id").isNotNull()).groupBy("object_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))


def viewer_references(entries: DataFrame, doc: str, order: str, raw: str, least: int = 20, most: int = 1200) -> DataFrame:
    """(doc, order, raw_text): references of `least` to `most` characters without table markup, each text once whatever its case."""
    t = entries.select(doc, order, T.squash(F.coalesce(raw, F.lit(""))).alias("raw_text")).withColumn("_low", F.lower("raw_text"))
    ok = F.length("raw_text").between(least, most)
    for tag in TABLE_TAGS:
        ok = ok & ~F.col("_low").contains(tag)
    w = Window.partitionBy(doc, "_low").orderBy(order)
    return t.where(ok).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(doc, order, "raw_text")


def evidence_heading(c: Column | str) -> Column:
    """A heading with single blanks; "Paper text" for none and for journal furniture."""
    h = T.squash(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return F.when((h == "") | lookup_key(h).isin("articleinfo", "checkforupdates"), "Paper text").otherwise(h)


def compact_evidence(units: DataFrame, by: str, order: list[str], most: int = 240, least: int = 20) -> DataFrame:
    """Units as a reader sees them: cleaned headings and texts, short ones only with something to show, each
    heading, page span and text once; the first `most` of a document.

    units: (by, order, heading, text, caption, image, page_start, page_end).
    """
    text, caption = T.squash(F.coalesce("text", F.lit(""))), F.nullif(T.squash(F.coalesce("caption", F.lit(""))), F.lit(""))
    u = units.withColumns({"heading": evidence_heading("heading"), "text": text, "caption": caption})
    shown = F.coalesce("caption", F.nullif("image", F.lit(""))).isNotNull()
    key = F.lower(F.coalesce(F.nullif("text", F.lit("")), "caption", "image", F.lit("")))
    u = u.where((F.length("text") >= least) | shown).withColumn("_k", key).withColumn("_h", F.lower("heading"))
    w = Window.partitionBy(by, "_h", "page_start", "page_end", "_k").orderBy(*order)
    first = u.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return first.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("position") <= most).drop("_r", "_k", "_h")


def image_url(doc: Column | str, path: Column | str, base: str = "") -> Column:
    """Address of a document's image by its file name; null without one or when the path leaves its folder."""
    p = F.col(path) if isinstance(path, str) else path
    name = F.regexp_extract(p, r"([^/\\]+)$", 1)
    d = F.col(doc) if isinstance(doc, str) else doc
    return F.when((F.coalesce(name, F.lit("")) != "") & ~p.rlike(r"(^|[/\\])\.\.([/\\]|$)"), F.concat(F.lit(base + "/papers/"), F.url_encode(d), F.lit("/images/"), F.url_encode(name)))
