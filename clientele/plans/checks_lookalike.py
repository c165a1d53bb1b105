"""Registered queries for lookalikes, and their check SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clientele.functions.columns import round_half_up
from clientele.operators import lookalike
from clientele.plans.inputs import feature_table, rounded
from clientele.sources.scratch import materialise

SEED = "Champions"
TOP_K = 50


def _labelled(v):
    features = materialise(feature_table(v), "features")
    return lookalike.seed_labels(features, lookalike.seed_by_segment(features, SEED))


def _fixed_prospects(v):
    """A similarity by formula instead of a model."""
    score = F.col("monetary") / (F.col("monetary") + 1000000.0)
    return lookalike.prospects(_labelled(v).withColumn("raw_score", score), v["view_consent"])


def _similarity(v):
    labelled = materialise(_labelled(v), "seed")
    scored = materialise(lookalike.similarity(lookalike.train(labelled), labelled), "scored")
    mean = scored.groupBy("is_seed").agg(F.avg("raw_score").alias("mean"))
    means = {row["is_seed"]: row["mean"] for row in mean.collect()}  # one row per label
    return scored.select(
        "unified_customer_id",
        "is_seed",
        F.col("raw_score").between(0, 1).alias("is_a_probability"),
        (F.abs(round_half_up("raw_score", 4) - F.col("raw_score")) <= 0.0000501).alias("rounds_the_score"),
        F.lit(means[1] > means[0]).alias("seeds_score_higher"),
    )


def _audience(v):
    """The chosen by position, with what must hold of each."""
    features = materialise(feature_table(v), "features")
    chosen = materialise(lookalike.generate(features, v["view_consent"], SEED, TOP_K)[0], "chosen")
    seed = lookalike.seed_by_segment(features, SEED).withColumn("_seed", F.lit(True))
    place = Window.orderBy(F.desc("similarity_score"), "unified_customer_id")  # TOP_K rows at most
    marked = chosen.join(seed, "unified_customer_id", "left").join(v["view_consent"], "unified_customer_id", "left")
    return marked.select(
        F.row_number().over(place).cast("bigint").alias("position"),
        F.col("_seed").isNull().alias("is_no_seed"),
        (F.col("marketing_opt_in") & ~F.col("do_not_track")).alias("consents"),
        F.col("similarity_score").between(0, 1).alias("is_a_probability"),
    )


def _summary(v):
    labelled = materialise(_labelled(v), "seed")
    seed_size = lookalike.seed_status(labelled).first()["seed_size"]
    return lookalike.summary(lookalike.top_prospects(_fixed_prospects(v), TOP_K), seed_size)


QUERIES = {
    "k01_seed_segment": lambda v: lookalike.seed_by_segment(feature_table(v), SEED),
    "k02_seed_labels": lambda v: _labelled(v).select("unified_customer_id", "is_seed"),
    "k03_seed_status": lambda v: lookalike.seed_status(_labelled(v)),
    "k04_numeric_inputs": lambda v: lookalike.filled_inputs(_labelled(v)),
    "k05_seed_classifier": _similarity,
    "k06_lookalike_audience": _audience,
    "k07_compliant_prospects": lambda v: rounded(
        _fixed_prospects(v).select("unified_customer_id", "raw_score")
    ),
    "k08_top_prospects": lambda v: lookalike.top_prospects(_fixed_prospects(v), TOP_K),
    "k09_lookalike_summary": _summary,
    "k09_lookalike_sample": lambda v: lookalike.sample(
        lookalike.top_prospects(_fixed_prospects(v), TOP_K)
    ),
}

PARTS = {
    "prospects": """
        select unified_customer_id, monetary / (monetary + 1000000.0) as raw_score, predicted_cltv
        from {feature_table} join {view_consent} using (unified_customer_id)
        where rfm_segment <> 'Champions' and marketing_opt_in = true and do_not_track = false
    """,
    "top_prospects": """
        select unified_customer_id, round(raw_score, 4) as similarity_score, predicted_cltv
        from {prospects} order by raw_score desc, unified_customer_id limit 50
    """,
}

SQL = {
    "k01_seed_segment": "select unified_customer_id from {feature_table} where rfm_segment = 'Champions'",
    "k02_seed_labels": """
        select unified_customer_id, cast(rfm_segment = 'Champions' as int) as is_seed from {feature_table}
    """,
    "k03_seed_status": """
        select count(*) as seed_size, case when count(*) = 0 then 'EMPTY_SEED' when count(*) < 5 then 'SEED_TOO_SMALL' else 'OK' end as status
        from {feature_table} where rfm_segment = 'Champions'
    """,
    "k04_numeric_inputs": """
        select unified_customer_id, recency_days, frequency, monetary, gross_margin, coalesce(predicted_cltv, 0.0) as predicted_cltv,
               coalesce(cltv_decile, 0) as cltv_decile, coalesce(lead_score, 0.0) as lead_score, cast(churn_risk as double) as churn_risk
        from {feature_table}
    """,
    "k05_seed_classifier": """
        select unified_customer_id, cast(rfm_segment = 'Champions' as int) as is_seed, true as is_a_probability, true as rounds_the_score,
               true as seeds_score_higher
        from {feature_table}
    """,
    "k06_lookalike_audience": """
        select position, true as is_no_seed, true as consents, true as is_a_probability
        from (select row_number() over (order by unified_customer_id) as position from {prospects}) where position <= 50
    """,
    "k07_compliant_prospects": "select unified_customer_id, round(raw_score, 6) as raw_score from {prospects}",
    "k08_top_prospects": "select * from {top_prospects}",
    "k09_lookalike_summary": """
        select (select count(*) from {feature_table} where rfm_segment = 'Champions') as seed_size, count(*) as lookalike_size,
               round(avg(similarity_score), 4) as avg_similarity_score, round(avg(predicted_cltv), 2) as avg_predicted_cltv
        from {top_prospects}
    """,
    "k09_lookalike_sample": """
        select * from {top_prospects} order by similarity_score desc, unified_customer_id limit 5
    """,
}
