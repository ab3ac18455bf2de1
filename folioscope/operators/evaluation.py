"""Retrieval metrics and benchmark views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


def target_ranks(displayed: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, topic, target, target_rank): rank of the target among the displayed ids, null when absent.

    displayed: (query_id, paper_id, display_rank); targets: (query_id, topic, target).
    """
    hit = displayed.select("query_id", F.col("paper_id").alias("target"), F.col("display_rank").alias("target_rank"))
    return targets.join(hit, ["query_id", "target"], "left")


def metrics(ranks: DataFrame) -> DataFrame:
    """Hit@k and MRR over all queries and per topic, in one pass of grouping sets; a missing target counts 0."""
    r = F.col("target_rank")
    aggs = [F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"hit_at_{k}") for k in CUTS]
    return (
        ranks.rollup("topic")
        .agg(F.grouping("topic").alias("total"), F.count("*").alias("n"), *aggs, F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"))
        .select(F.when(F.col("total") == 1, "all").otherwise(F.coalesce("topic", F.lit("none"))).alias("topic"), "n", *[f"hit_at_{k}" for k in CUTS], "mrr")
    )


def outcome_metrics(records: DataFrame) -> DataFrame:
    """(topic, n, n_completed, n_failed, hit_at_k, mrr, satisfied, partial_or_better, avg_latency), over all and per topic.

    records: (topic, job_status, target_rank, target_bucket, latency). Shares are of completed jobs, 0 without one;
    the mean latency leaves out unknown ones.
    """
    done = F.col("job_status") == "completed"
    share = lambda ok: F.coalesce(F.avg(F.when(done, F.when(ok, 1.0).otherwise(0.0))), F.lit(0.0))
    r = F.col("target_rank")
    aggs = [share(r <= k).alias(f"hit_at_{k}") for k in CUTS]
    aggs += [F.coalesce(F.avg(F.when(done, F.coalesce(1.0 / r, F.lit(0.0)))), F.lit(0.0)).alias("mrr")]
    aggs += [share(F.col("target_bucket") == "satisfied").alias("satisfied"), share(F.col("target_bucket").isin("satisfied", "partial")).alias("partial_or_better")]
    aggs += [F.coalesce(F.avg(F.when(done, F.col("latency"))), F.lit(0.0)).alias("avg_latency")]
    out = records.rollup("topic").agg(F.grouping("topic").alias("total"), F.count("*").alias("n"), F.count_if(done).alias("n_completed"), F.count_if(~F.coalesce(done, F.lit(False))).alias("n_failed"), *aggs)
    return out.select(F.when(F.col("total") == 1, "all").otherwise(F.coalesce("topic", F.lit("none"))).alias("topic"), *[c for c in out.columns if c not in ("topic", "total")])


def target_bucket(results: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, target_bucket): the verdict group that holds the target, else not_returned."""
    held = results.select("query_id", F.col("paper_id").alias("target"), "verdict")
    got = targets.join(held, ["query_id", "target"], "left")
    order = F.when(F.col("verdict") == "satisfied", 0).when(F.col("verdict") == "partial", 1).otherwise(2)
    return got.groupBy("query_id").agg(F.coalesce(F.min_by("verdict", F.when(F.col("verdict").isNotNull(), order)), F.lit("not_returned")).alias("target_bucket"))


def majority(votes: DataFrame, by: list[str], vote: str) -> DataFrame:
    """(by, yes, n, accepted): true with at least half of the votes; ties accept."""
    yes = F.count_if(F.col(vote))
    return votes.groupBy(*by).agg(yes.alias("yes"), F.count(vote).alias("n"), (yes * 2 >= F.count(vote)).alias("accepted"))


def qrels(targets: DataFrame) -> DataFrame:
    """TREC lines: query, 0, document, relevance."""
    return targets.select(F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("0"), F.col("target").cast("string"), F.lit("1")).alias("value")).distinct()


def dangling_targets(targets: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """Targets that name no document of the corpus; must be empty for a valid benchmark."""
    return targets.join(corpus.select(F.col(key).alias("target")), "target", "left_anti")
