"""Scope, verdict and display selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import squash
from folioscope.operators.ranking import steady


def scope(df: DataFrame, venues: list[str] = (), years: list[int] = (), tracks: list[str] = ()) -> DataFrame:
    """Rows whose venue, year and track are listed; an empty list is no constraint. Reaches the scan as filters."""
    for col, values in (("venue", venues), ("year", years), ("track", tracks)):
        if values:
            df = df.where(F.lower(F.col(col).cast("string")).isin([str(v).lower() for v in values]))
    return df


def library_filter(df: DataFrame, text: str) -> DataFrame:
    """Case-insensitive containment in title or an author."""
    t = text.lower()
    return df.where(F.lower(F.coalesce("title", F.lit(""))).contains(t) | F.exists(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.lower(a).contains(t)))


def eligible_passages(chunks: DataFrame, papers: DataFrame, least: int = 20) -> DataFrame:
    """Chunks of known papers whose trimmed text has at least `least` characters."""
    return chunks.where(F.length(squash(F.coalesce("text", F.lit("")))) >= least).join(papers.select("paper_id").distinct(), "paper_id", "left_semi")


def best_query(scores: DataFrame, by: list[str], query: str, order: str) -> DataFrame:
    """Per group the query of highest positive score, the earlier on ties."""
    return scores.where(F.col("score") > 0).groupBy(*by).agg(F.max("score").alias("score"), F.min_by(query, F.struct(-F.col("score"), F.col(order))).alias(query))


def trim(df: DataFrame, by: list[str], keep: Column, score: str, key: str, top_k: int) -> DataFrame:
    """All rows to keep, and top_k more by score."""
    w = Window.partitionBy(*by, "_keep").orderBy(F.desc(score), F.asc(key))
    return df.withColumn("_keep", keep).withColumn("_r", F.row_number().over(w)).where(F.col("_keep") | (F.col("_r") <= top_k)).drop("_keep", "_r")


def verdict_top(df: DataFrame, by: list[str], score: str, key: str, top_k: int) -> DataFrame:
    """The top_k rows of each verdict."""
    w = Window.partitionBy(*by, "verdict").orderBy(steady(df, score).desc(), F.asc(key))
    return df.withColumn("verdict_rank", F.row_number().over(w)).where(F.col("verdict_rank") <= top_k)


def display_fill(df: DataFrame, by: list[str], display_k: int) -> DataFrame:
    """Satisfied first, then partial, by verdict_rank, to display_k rows; rejected rows are never shown."""
    shown = df.where(F.col("verdict").isin("satisfied", "partial"))
    w = Window.partitionBy(*by).orderBy(F.when(F.col("verdict") == "satisfied", 0).otherwise(1), F.col("verdict_rank"))
    return shown.withColumn("display_rank", F.row_number().over(w)).where(F.col("display_rank") <= display_k)


def last_turns(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last n turns of each conversation."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def pick_in_order(df: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the wanted ids with their position, wanted ids that are missing). wanted: (position, key)."""
    found = df.join(wanted, key)
    return found, wanted.join(df.select(key), key, "left_anti")
