"""Sinks: record tables by corpus and build, index tables, exports, resumable shards, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.sources.readers import empty, exists

MANIFEST = "corpus_key string, build_id string, path string, n_rows bigint, published_at timestamp"


def write_records(df: DataFrame, path: str, by: str | None = "corpus_key") -> None:
    """Parquet, one directory per corpus; rows are clustered by it first, salted so that a corpus with a third
    of all rows is no single task. The committer makes the job atomic."""
    if by:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns if c != by][:1]), F.lit(16))).repartition(by, "_salt").drop("_salt")
        df.write.mode("overwrite").partitionBy(by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def index_table(df: DataFrame, key: str, text: Column, build_id: str, model_id: str) -> DataFrame:
    """One wide row per item: id, search text, tokens and provenance."""
    return df.select(F.col(key).alias("item_id"), text.alias("search_text")).select("item_id", "search_text", T.tokens("search_text").alias("tokens"), F.lit(build_id).alias("build_id"), F.lit(model_id).alias("model_id"))


def encode_resumable(spark: SparkSession, df: DataFrame, key: str, encode: Column, path: str) -> int:
    """Appends vectors of the items that have none yet; returns the number of items that were missing.

    A rerun is a no-op: the anti-join is on the ids already written.
    """
    schema = "item_id string, vector array<float>"
    done = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    todo = df.join(done.select(F.col("item_id").alias(key)), key, "left_anti")
    n = todo.count()
    if n:
        todo.select(F.col(key).cast("string").alias("item_id"), encode.alias("vector")).write.mode("append").parquet(path)
    return n


def publish(spark: SparkSession, df: DataFrame, root: str, corpus_key: str, build_id: str) -> None:
    """Writes a build into its own directory and then appends its pointer to the manifest.

    Readers resolve the latest pointer, so they see the old build until the row is committed.
    """
    path = f"{root.rstrip('/')}/builds/{T_slug(corpus_key)}/{build_id}"
    df.write.mode("overwrite").parquet(path)
    n = spark.read.parquet(path).count()
    if not n:
        raise ValueError("refusing to publish an empty build")
    row = spark.createDataFrame([(corpus_key, build_id, path, n)], "corpus_key string, build_id string, path string, n_rows bigint")
    row.withColumn("published_at", F.current_timestamp()).write.mode("append").parquet(f"{root.rstrip('/')}/manifest")


def T_slug(key: str) -> str:
    return "".join(c if c.isalnum() else "-" for c in key.lower())


def manifest(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root.rstrip('/')}/manifest"
    return spark.read.schema(MANIFEST).parquet(path) if exists(spark, path) else spark.createDataFrame([], MANIFEST)


def current_builds(spark: SparkSession, root: str) -> DataFrame:
    """(corpus_key, build_id, path, n_rows) of the latest pointer of each corpus."""
    return manifest(spark, root).groupBy("corpus_key").agg(F.max_by(F.struct("build_id", "path", "n_rows"), F.struct("published_at", "build_id")).alias("s")).select("corpus_key", "s.*")


def read_current(spark: SparkSession, root: str, corpus_key: str, schema) -> DataFrame:
    hit = current_builds(spark, root).where(F.col("corpus_key") == corpus_key).head()
    return spark.read.parquet(hit["path"]) if hit else empty(spark, schema)


def fingerprint(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """(by, n_rows, fingerprint): order-free hash of the rows, mergeable map-side, no sorting of a group."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"}), 256)
    part = [F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    sums = [F.sum(p).alias(f"_h{i}") for i, p in enumerate(part)]
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), *sums).select(*by, "n_rows", F.sha2(F.concat_ws(":", "n_rows", *[F.col(f"_h{i}") for i in range(4)]), 256).alias("fingerprint"))


def rebase_paths(c: str, old: str, new: str) -> Column:
    """Image paths moved from one root to another; others stay."""
    return F.when(F.startswith(F.col(c), F.lit(old)), F.concat(F.lit(new), F.substring(F.col(c), F.lit(len(old) + 1), F.length(c)))).otherwise(F.col(c))


def bibtex(df: DataFrame) -> DataFrame:
    """(paper_id, value): BibTeX entries; blank fields are left out."""
    fields = []
    esc = T.bibtex_escape
    for name, col in (
        ("title", T.squash("title")),
        ("author", F.array_join(F.transform(F.filter("authors", lambda a: F.trim(a) != ""), T.squash), " and ")),
        ("booktitle", F.upper("venue")),
        ("year", F.col("year").cast("string")),
        ("doi", F.col("doi")),
        ("url", F.col("url")),
        ("abstract", T.squash("abstract")),
    ):
        fields.append(F.when(F.coalesce(col, F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), esc(col), F.lit("}"))))
    body = F.array_join(F.array_compact(F.array(*fields)), ",\n")
    return df.select("paper_id", F.concat(F.lit("@inproceedings{"), T.slug("paper_id"), F.lit(",\n"), body, F.lit("\n}")).alias("value"))


def ris(df: DataFrame) -> DataFrame:
    """(paper_id, value): RIS entries."""
    one = lambda tag, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{tag}  - "), c))
    authors = F.transform(F.filter(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.trim(a) != ""), lambda a: F.concat(F.lit("AU  - "), T.squash(a)))
    parts = F.concat(
        F.array(F.lit("TY  - CONF")), F.array(one("TI", T.squash("title"))), authors,
        F.array(one("T2", F.upper("venue")), one("PY", F.col("year").cast("string")), one("DO", F.col("doi")), one("UR", F.col("url")), one("AB", T.squash("abstract"))), F.array(F.lit("ER  - ")),
    )
    return df.select("paper_id", F.array_join(F.array_compact(parts), "\n").alias("value"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def feedback(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) votes: up or down, a reason with a down vote, lengths of 256, 4000 and 2000 at most."""
    ok = (
        F.col("vote").isin("up", "down")
        & ((F.col("vote") == "up") | (T.squash(F.coalesce("reason", F.lit(""))) != ""))
        & (F.length("target") <= 256)
        & (F.length(F.coalesce("query", F.lit(""))) <= 4000)
        & (F.length(F.coalesce("reason", F.lit(""))) <= 2000)
    )
    ok = F.coalesce(ok, F.lit(False))
    return df.where(ok), df.where(~ok)
