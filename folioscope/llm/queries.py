"""Queries of this subpackage: every one over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import leaks, mojibake, names, neardup, neighbours, scans, split, tokenise
from folioscope.llm.graph import components
from folioscope.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of at least 0.9, searched for in small cells."""
    near = neighbours.most_similar(table(spark, d, "index_vectors"), floor=0.9, ef=16, cell_rows=1024)
    return near.select(F.col("grp").alias("bundle"), F.least("item", "neighbour").alias("item_a"), F.greatest("item", "neighbour").alias("item_b")).distinct()


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar of all items, whatever their similarity, for every item whose hash is divisible by 100; all shards are searched."""
    near = neighbours.most_similar(table(spark, d, "index_vectors"), asked=F.pmod(F.xxhash64("item"), F.lit(100)) == 0)
    return near.select(F.col("grp").alias("bundle"), F.col("item").alias("item_id"), "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    papers = table(spark, d, "papers")
    return scans.scan_records(table(spark, d, "layout_objects"), table(spark, d, "sections"), papers), papers


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.Scan(*_records(spark, d)).kinds()


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    records, papers = _records(spark, d)
    return scans.Scan(records, papers).repaired(records)


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "sections"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).select("section_id").distinct()


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    return split.new_members(table(spark, d, "sections"))


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    nick = names.nickname_map(table(spark, d, "nicknames"))
    author = names.link_variants(names.distinct_names(table(spark, d, "papers"), "authors"), True, nick)
    organisation = names.link_variants(names.distinct_names(table(spark, d, "header_results"), "affiliations"), False, nick)
    return author.withColumn("kind", F.lit("author")).unionByName(organisation.withColumn("kind", F.lit("organisation"))).select("kind", "name", "entity")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(p5_entities(spark, d).withColumn("entity", F.struct("kind", "entity"))).select("entity.kind", "name_a", "name_b")


def _papers_alike(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    return neardup.near_duplicates(table(spark, d, "papers"), "paper_id", ["title", "abstract", "text"], "ingested_at", n=3, threshold=0.6)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.expand_pairs(_papers_alike(spark, d)).select(F.col("a").alias("paper_a"), F.col("b").alias("paper_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    alike = _papers_alike(spark, d)
    group = components(alike.links, "class_a", "class_b")
    return alike.members.join(group.select(F.col("id").alias("class_id"), "component"), "class_id", "left").select(
        F.col("id").alias("paper_id"), "class_id", F.coalesce("component", "class_id").alias("group_id")
    )


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenise.encode_texts(table(spark, d, "documents"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_spans(spark, d).select("doc_id", "item_id").distinct()


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leaks.remove_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_texts(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_restored(spark, d).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_repaired, p5_found, p5_entities, p4_found, p4_pieces, p4_members, p6_found, p6_groups, p7_ids, p8_found, p8_spans, p8_cleaned, p9_found, p9_restored)
}
