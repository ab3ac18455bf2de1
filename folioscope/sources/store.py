"""Keyed stores without a table format: versioned rows, latest wins; traces, projects, sessions, job views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.sources.readers import exists

ENTRY = "kind string, key string, body string, created_at timestamp, updated_at timestamp, deleted boolean"
TRACE = "trace_id string, created_at timestamp, query string, body string"


class KeyedStore:
    """Entries by kind and key in an append-only Parquet table; a save keeps the first created_at."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], ENTRY)

    def entries(self, kind: str) -> DataFrame:
        """Live entries, newest first by key order of (updated_at, created_at, key)."""
        v = self.versions().where(F.col("kind") == kind)
        last = v.groupBy("key").agg(F.max_by(F.struct("body", "updated_at", "deleted"), F.struct("updated_at", "deleted")).alias("s"), F.min("created_at").alias("created_at"))
        return last.where(~F.col("s.deleted")).select("key", F.col("s.body").alias("body"), "created_at", F.col("s.updated_at").alias("updated_at")).orderBy(F.desc("updated_at"), F.desc("created_at"), "key")

    def save(self, rows: DataFrame, kind: str, deleted: bool = False) -> None:
        """rows: (key, body). One append per call, so concurrent writers lose nothing."""
        now = F.current_timestamp()
        body = F.col("body") if "body" in rows.columns else F.lit(None).cast("string")
        rows.select(F.lit(kind).alias("kind"), "key", body.alias("body"), now.alias("created_at"), now.alias("updated_at"), F.lit(deleted).alias("deleted")).write.mode("append").parquet(self.path)

    def delete(self, keys: DataFrame, kind: str) -> None:
        self.save(keys, kind, True)

    def compact(self, path: str) -> None:
        """The live entries of all kinds as a fresh table."""
        v = self.versions()
        last = v.groupBy("kind", "key").agg(F.max_by(F.struct("body", "updated_at", "deleted"), F.struct("updated_at", "deleted")).alias("s"), F.min("created_at").alias("created_at")).where(~F.col("s.deleted"))
        last.select("kind", "key", F.col("s.body").alias("body"), "created_at", F.col("s.updated_at").alias("updated_at"), F.lit(False).alias("deleted")).write.mode("overwrite").parquet(path)


def unique_slugs(names: DataFrame, taken: DataFrame) -> DataFrame:
    """(position, slug): slugs of new names, numbered from -2 on where they repeat or are taken."""
    from folioscope.functions.text import slug

    base = names.select("position", slug("name").alias("base"))
    used = taken.select(F.regexp_replace("slug", r"-\d+$", "").alias("base"), F.coalesce(F.regexp_extract("slug", r"-(\d+)$", 1).try_cast("int"), F.lit(1)).alias("n")).groupBy("base").agg(F.max("n").alias("top"))
    w = Window.partitionBy("base").orderBy("position")
    n = base.join(used, "base", "left").withColumn("n", F.coalesce("top", F.lit(0)) + F.row_number().over(w))
    return n.select("position", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string"))).alias("slug"))


def save_trace(df: DataFrame, path: str) -> None:
    """Traces live outside the snapshots, so a rebuild carries them over."""
    df.select("trace_id", "created_at", "query", "body").write.mode("append").parquet(path)


def find_trace(spark: SparkSession, paths: list[str], trace_id: str) -> DataFrame:
    """The trace from the first place that has it: live, current, then the corpora."""
    out = None
    for i, p in enumerate(p for p in paths if exists(spark, p)):
        t = spark.read.schema(TRACE).parquet(p).where(F.col("trace_id") == trace_id).withColumn("_place", F.lit(i))
        out = t if out is None else out.unionByName(t)
    if out is None:
        return spark.createDataFrame([], TRACE)
    return out.orderBy("_place", F.desc("created_at")).limit(1).drop("_place")


def replace_papers(old: DataFrame, new: DataFrame, key: str = "paper_id") -> DataFrame:
    """Rows of the papers in `new` replaced, all others kept."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def resume(todo: DataFrame, done: DataFrame, failed: DataFrame, key: str = "paper_id") -> DataFrame:
    """Work that is neither complete nor failed before."""
    return todo.join(done.select(key), key, "left_anti").join(failed.select(key), key, "left_anti")


def batches(files: DataFrame, most_files: int, most_pages: int) -> DataFrame:
    """(batch_no, path, pages): files in order, packed greedily by number and pages; a driver-side plan over a
    listing whose files each cost an external call."""
    rows = files.select("path", "pages").orderBy("path").toLocalIterator()
    out, no, n, pages = [], 0, 0, 0
    for r in rows:
        if n and (n >= most_files or pages + r["pages"] > most_pages):
            no, n, pages = no + 1, 0, 0
        out.append((no, r["path"], r["pages"]))
        n, pages = n + 1, pages + r["pages"]
    return files.sparkSession.createDataFrame(out, "batch_no int, path string, pages int")


def merge_state(counts: DataFrame) -> DataFrame:
    """(n_papers, n_corpora, n_fingerprints, consistent): sums over corpora of counts already deduplicated, and
    whether one encoder fingerprint is used by all."""
    return counts.agg(F.sum("n_papers").alias("n_papers"), F.countDistinct("corpus_key").alias("n_corpora"), F.countDistinct("fingerprint").alias("n_fingerprints"), (F.countDistinct("fingerprint") <= 1).alias("consistent"))


def price(calls: DataFrame, prompt_price: float | None, completion_price: float | None) -> DataFrame:
    """Adds cost per call; null when a price or a count is missing."""
    p = F.lit(prompt_price).cast("double") * F.col("prompt_tokens") / 1e6
    c = F.lit(completion_price).cast("double") * F.col("completion_tokens") / 1e6
    return calls.withColumn("cost", p + c)


def report(metrics: DataFrame, title: str) -> str:
    """A Markdown table of a small metrics frame."""
    head = metrics.columns
    rows = [[f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in metrics.orderBy(head[0]).toLocalIterator()]
    return "\n".join([f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(r) + " |" for r in rows)]) + "\n"
