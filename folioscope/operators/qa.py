"""Competing readings of a question inside one document: signals, grounding, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.ranking import rank_within

MARGIN = 0.02


def bucket_scores(sparse: DataFrame, dense: DataFrame, units: DataFrame, by: list[str], preferred: DataFrame, limit: int = 16) -> DataFrame:
    """(by, evidence_id, score): half and half reciprocal ranks of the two top-`limit` lists, .08 for a preferred type.

    preferred: (by, evidence_type).
    """
    ranked = None
    for s in (sparse, dense):
        r = rank_within(s.join(units.select("evidence_id"), "evidence_id", "left_semi"), by, "score", "evidence_id", limit).select(*by, "evidence_id", "rank")
        ranked = r if ranked is None else ranked.unionByName(r)
    fused = ranked.groupBy(*by, "evidence_id").agg(F.sum(0.5 / (60 + F.col("rank"))).alias("fused"))
    typed = fused.join(units.select("evidence_id", "evidence_type"), "evidence_id").join(preferred.distinct().withColumn("liked", F.lit(0.08)), [*by, "evidence_type"], "left")
    return typed.select(*by, "evidence_id", "evidence_type", (F.col("fused") + F.coalesce("liked", F.lit(0.0))).alias("score"))


def strongest_competitor(scores: DataFrame, question: str) -> DataFrame:
    """Adds other_id and other: for every hypothesis and evidence the best score of another hypothesis of the question.

    The two best scores of each evidence suffice, so there is no self-join: the best is everyone's
    competitor but its own, whose competitor is the second.
    """
    w = Window.partitionBy(question, "evidence_id").orderBy(F.desc("score"), "hypothesis_id")
    r = scores.withColumn("_r", F.row_number().over(w))
    first = F.first(F.struct("hypothesis_id", "score")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    second = F.nth_value(F.struct("hypothesis_id", "score"), 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    other = F.when(F.col("_r") == 1, second).otherwise(first)
    positive = other["score"] > 0
    return r.withColumn("other_id", F.when(positive, other["hypothesis_id"])).withColumn("other", F.when(positive, other["score"]).otherwise(0.0)).drop("_r")


def competition_evidence(scores: DataFrame, question: str, mode: str, top_k: int) -> DataFrame:
    """Evidence that separates a hypothesis from its competitors (discriminative) or speaks for them (conflicting)."""
    s = strongest_competitor(scores, question)
    own, other = F.col("score"), F.col("other")
    m = s.withColumn("margin", own - other).where((own > 0) & (own - other > MARGIN)) if mode == "discriminative" else s.withColumn("margin", other - own).where((other > 0) & (other - own > MARGIN))
    return rank_within(m, [question, "hypothesis_id"], "margin", "evidence_id", top_k)


def competition_signal(scores: DataFrame, question: str) -> DataFrame:
    """(question, hypothesis_id, support, margin_vs_next, strongest_competitor): means of the three best scores."""
    w = Window.partitionBy(question, "hypothesis_id").orderBy(F.desc("score"), "evidence_id")
    top = scores.withColumn("_r", F.row_number().over(w)).where("_r <= 3").groupBy(question, "hypothesis_id").agg(F.avg("score").alias("support"))
    every = top.withColumn("score", F.col("support")).withColumn("evidence_id", F.lit("-"))
    out = strongest_competitor(every, question)
    return out.select(question, "hypothesis_id", "support", (F.col("support") - F.col("other")).alias("margin_vs_next"), F.col("other_id").alias("strongest_competitor"))


def competition_outcome(scores: DataFrame, question: str, top_k: int = 3) -> DataFrame:
    """competition_signal() with discriminative_score and conflicting_score, the mean margins of the `top_k` pieces of
    evidence of either kind; 0 without one."""
    out = competition_signal(scores, question)
    for mode in ("discriminative", "conflicting"):
        m = competition_evidence(scores, question, mode, top_k).groupBy(question, "hypothesis_id").agg(F.avg("margin").alias(f"{mode}_score"))
        out = out.join(m, [question, "hypothesis_id"], "left")
    return out.fillna(0.0, ["discriminative_score", "conflicting_score"])


def ungrounded(cited: DataFrame, pack: DataFrame) -> DataFrame:
    """Citations outside the evidence pack of their hypothesis; must be empty."""
    return cited.join(pack.select("hypothesis_id", "evidence_id").distinct(), ["hypothesis_id", "evidence_id"], "left_anti")


def uncovered(hypotheses: DataFrame, facts: DataFrame) -> DataFrame:
    """Hypotheses without facts or with several fact lists; must be empty."""
    n = facts.groupBy("hypothesis_id").agg(F.countDistinct("fact_list").alias("lists"))
    return hypotheses.join(n, "hypothesis_id", "left").where(F.coalesce("lists", F.lit(0)) != 1).select("hypothesis_id")


def decide(verified: DataFrame) -> DataFrame:
    """Adds decision: ask_clarification, unsupported, answer_with_note or answer."""
    clarify = F.col("interpretation_verdict").isin("ambiguous", "incorrect") | (F.col("competition_verdict") == "no_clear_winner")
    lost = (F.col("support_verdict") == "unsupported") | (F.col("alignment_verdict") == "misaligned")
    noted = (F.col("support_verdict") == "partially_supported") | (F.col("alignment_verdict") == "partially_aligned") | (F.col("competition_verdict") == "weak_winner")
    return verified.withColumn("decision", F.when(clarify, "ask_clarification").when(lost, "unsupported").when(noted, "answer_with_note").otherwise("answer"))
