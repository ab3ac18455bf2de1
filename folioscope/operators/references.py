"""Orphan references: keys in one table that name no valid row of another.

States (one per distinct referring record and target): `deleted` when the last removal is at or after
the target's last ingestion, or it is logged without any row; `missing` when it has no row and no log
entry; `late` when its first ingestion is more than `late_hours` after the referring record's first
ingestion. Everything else is a sound reference, and an inherited orphan when its target is orphaned.

Ids of either side are compared trimmed and in lower case.

Nulls: null or blank references are no references; a null record id, ingestion or removal time never
crashes - a null ingestion time counts as absent from min/max, so it can make nothing late. Extra
columns are ignored because every input is projected to the named columns first. Empty tables give
empty results. Repeated rows collapse through min/max aggregation before any join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.runtime import materialise

BLANK = r"(?U)^[\s\x{200b}\x{feff}]+|[\s\x{200b}\x{feff}]+$"


@dataclass(frozen=True)
class ForeignKey:
    """ref_table.ref_column (a string or an array of strings) names target_table.target_id."""

    ref_table: str
    ref_id: str
    ref_column: str
    target_table: str
    target_id: str


def clean_key(c: Column | str) -> Column:
    """A reference trimmed (any Unicode white space) and in lower case; null when nothing is left."""
    s = F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, BLANK, ""))
    return F.when(s != "", s)


def reference_edges(df: DataFrame, fk: ForeignKey) -> DataFrame:
    """(ref_table, record_id, target_table, target_id, ref_first): distinct references of one key.

    The record's first ingestion is taken over all its rows, also those without the reference; a window
    would shuffle whole rows, so both aggregates ride on one pre-aggregated shuffle by record: each
    row sends its distinct keys, sets merge map-side, and the sets are unnested after it.
    """
    keys = F.col(fk.ref_column)
    if dict(df.dtypes)[fk.ref_column].startswith("array"):
        keys = F.array_distinct(F.filter(F.transform(keys, clean_key), lambda x: x.isNotNull()))
    else:
        keys = F.filter(F.array(clean_key(keys)), lambda x: x.isNotNull())
    rows = df.select(F.col(fk.ref_id).alias("record_id"), keys.alias("keys"), F.col("ingested_at").alias("at"))
    first = rows.groupBy("record_id").agg(F.min("at").alias("ref_first"), F.collect_set("keys").alias("sets"))
    return first.select(
        F.lit(fk.ref_table).alias("ref_table"),
        "record_id",
        F.lit(fk.target_table).alias("target_table"),
        F.explode(F.array_distinct(F.flatten("sets"))).alias("target_id"),
        "ref_first",
    )


def key_state(tables: dict[str, DataFrame], keys: list[tuple[str, str]], removals: DataFrame) -> DataFrame:
    """(target_table, target_id, first_in, last_in, last_removed) of every stored or logged key."""
    parts = []
    for name, key in keys:
        at = F.col("ingested_at")
        none = F.lit(None).cast("timestamp")
        parts.append(
            tables[name].select(F.lit(name).alias("target_table"), clean_key(key).alias("target_id"), at.alias("at"), none.alias("gone"), F.lit(1).alias("stored"), F.lit(0).alias("logged"))
        )
    none = F.lit(None).cast("timestamp")
    parts.append(
        removals.where(F.col("record_table").isin([n for n, _ in keys])).select(
            F.col("record_table").alias("target_table"), clean_key("record_id").alias("target_id"), none.alias("at"), F.col("removed_at").cast("timestamp").alias("gone"), F.lit(0).alias("stored"), F.lit(1).alias("logged")
        )
    )
    df = parts[0].withColumn("at", F.col("at").cast("timestamp"))
    for p in parts[1:]:
        df = df.unionByName(p.withColumn("at", F.col("at").cast("timestamp")))
    return (
        df.where(F.col("target_id").isNotNull())
        .groupBy("target_table", "target_id")
        .agg(F.min("at").alias("first_in"), F.max("at").alias("last_in"), F.max("gone").alias("last_removed"), F.max("stored").alias("stored"), F.max("logged").alias("logged"))
    )


def reference_states(tables: dict[str, DataFrame], keys: list[ForeignKey], removals: DataFrame, late_hours: int = 24) -> DataFrame:
    """(ref_table, record_id, target_table, target_id, ref_first, state) of every distinct reference; sound ones have no state.

    One equi-join of the distinct references with the aggregated key states; the join key is the pair
    of table and id, which is unique on the state side, so a hot target costs one state row.
    """
    edges = None
    for fk in keys:
        e = reference_edges(tables[fk.ref_table], fk)
        edges = e if edges is None else edges.unionByName(e)
    targets = sorted({(fk.target_table, fk.target_id) for fk in keys})
    known = key_state(tables, targets, removals)
    joined = edges.join(known, ["target_table", "target_id"], "left")
    stored, logged = F.coalesce(F.col("stored"), F.lit(0)) == 1, F.coalesce(F.col("logged"), F.lit(0)) == 1
    state = (
        F.when(logged & (~stored | (F.col("last_removed") >= F.col("last_in"))), "deleted")
        .when(~stored, "missing")
        .when(F.col("first_in").cast("timestamp") > F.col("ref_first").cast("timestamp") + F.expr(f"INTERVAL {late_hours} HOURS"), "late")
    )
    return joined.select("ref_table", "record_id", "target_table", "target_id", "ref_first", state.alias("state"))


class OrphanCascade:
    """The fixpoint down the foreign-key graph.

    A record with a deleted or missing reference is a direct orphan (depth 0); a record that refers to
    an orphaned record inherits it (depth = rounds needed). Every round semi-joins the references with the
    last frontier only and stops when that is empty. References and frontiers are laid down as tables in the
    shared folder, which ends their lineage and gives the planner true sizes: it broadcasts a small frontier
    and shuffles a large one. Late targets exist, so they orphan nothing.
    """

    def __init__(self, tables: dict[str, DataFrame], keys: list[ForeignKey], removals: DataFrame, late_hours: int = 24):
        ref = ["ref_table", "record_id"]
        self.references = materialise(reference_states(tables, keys, removals, late_hours))
        lost = self.references.where(F.col("state").isin("deleted", "missing"))
        rounds = [materialise(lost.select(*ref).distinct().withColumn("depth", F.lit(0)))]
        # an id is compared as references are: trimmed and in lower case
        as_target = lambda df: df.select(F.col("ref_table").alias("target_table"), clean_key("record_id").alias("target_id"))
        found = rounds[0]
        while not rounds[-1].isEmpty():
            hit = self.references.join(as_target(rounds[-1]), ["target_table", "target_id"], "left_semi").select(*ref).distinct()
            rounds.append(materialise(hit.join(found, ref, "left_anti").withColumn("depth", F.lit(len(rounds)))))
            found = found.unionByName(rounds[-1])
        self.found = found
        self._as_target = as_target

    def records(self) -> DataFrame:
        """(ref_table, record_id, orphan, depth): one row per orphaned record."""
        return self.found.select("ref_table", "record_id", F.when(F.col("depth") == 0, "direct").otherwise("inherited").alias("orphan"), "depth")

    def orphans(self) -> DataFrame:
        """(ref_table, record_id, target_table, target_id, orphan, state, ref_first): every orphan reference.

        Direct ones have a state; inherited ones, which name an orphaned record and are sound themselves, have none.
        """
        direct = self.references.where(F.col("state").isNotNull()).withColumn("orphan", F.lit("direct"))
        sound = self.references.where(F.col("state").isNull())
        inherited = sound.join(self._as_target(self.found).distinct(), ["target_table", "target_id"], "left_semi").withColumn("orphan", F.lit("inherited"))
        return direct.unionByName(inherited).select("ref_table", "record_id", "target_table", "target_id", "orphan", "state", "ref_first")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts of orphan references per referring table, month of its first ingestion, direct or inherited, and state."""
    return orphans.groupBy("ref_table", F.date_format("ref_first", "yyyy-MM").alias("period"), "orphan", "state").agg(
        F.count("*").alias("n_references"), F.countDistinct("record_id").alias("n_records")
    )
