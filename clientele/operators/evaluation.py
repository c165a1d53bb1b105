"""Classifier metrics on (id, label, score) rows, exact under tied scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.functions.columns import round_half_up
from clientele.operators.ranking import after, rows_at_ranks, running_totals


def score_groups(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("positives"),
        F.sum(1 - F.col(label).cast("bigint")).alias("negatives"),
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve: the share of (positive, negative) pairs in the right order.

    A tied pair counts one half, as with mean ranks.
    """
    totals = running_totals(
        score_groups(df, label, score), ["score"], {"below_or_equal": "negatives"}
    )
    won = F.col("positives") * (F.col("below_or_equal") - F.col("negatives") / 2)
    pairs = F.sum("positives").cast("double") * F.sum("negatives")
    return totals.agg(round_half_up(F.when(pairs > 0, F.sum(won) / pairs), 3).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the precision-recall steps: sum of recall gain times precision."""
    falling = score_groups(df, label, score).withColumn("falling", -F.col("score"))
    totals = running_totals(falling, ["falling"], {"tp": "positives", "fp": "negatives"})
    step = F.col("positives").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp"))
    hits = F.sum("positives")
    return totals.agg(round_half_up(F.when(hits > 0, F.sum(step) / hits), 3).alias("pr_auc"))


def brier_score(label: str, score: str) -> Column:
    """Aggregate: mean squared distance of score and label."""
    return round_half_up(F.avg(F.pow(F.col(score) - F.col(label), F.lit(2))), 3).alias("brier_score")


def decile_lift(label: str, decile: str) -> list[Column]:
    """Aggregates: base rate, conversion in the top decile, and its lift over the base rate."""
    base = F.avg(label)
    top = F.avg(F.when(F.col(decile) == 10, F.col(label)))
    return [
        round_half_up(base, 4).alias("positive_rate"),
        round_half_up(top, 3).alias("top_decile_cvr"),
        round_half_up(F.when(base > 0, top / base).otherwise(1.0), 2).alias("top_decile_lift"),
    ]


def precision_recall_at_top(
    df: DataFrame, id_col: str, label: str, score: str, percent: int = 10
) -> DataFrame:
    """Precision and recall of the best-scored ``max(1, n * percent // 100)`` rows."""
    ordered = df.select((-F.col(score)).alias("_falling"), F.col(id_col).alias("_id"))
    edge = rows_at_ranks(ordered, ["_falling", "_id"], lambda n: [max(1, n * percent // 100)] if n else [])
    if edge:
        last = next(iter(edge.values()))
        selected = ~after(-F.col(score), F.col(id_col), last["_falling"], last["_id"])
    else:
        selected = F.lit(False)
    hits = F.sum(F.when(selected, F.col(label)).otherwise(0))
    return df.agg(
        round_half_up(hits / F.count_if(selected), 3).alias(f"precision_at_top_{percent}pct"),
        round_half_up(F.when(F.sum(label) > 0, hits / F.sum(label)).otherwise(0.0), 3).alias(
            f"recall_at_top_{percent}pct"
        ),
    )
