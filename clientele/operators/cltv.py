"""Customer lifetime value: features before a cutoff, revenue after it, a boosted-tree model."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.functions.columns import dated, days_before, exact_sum, hash_bucket, round_half_up, whole_days
from clientele.operators.ranking import quantile_buckets
from clientele.operators.rfm import CUSTOMER, NEVER
from clientele.sources.scratch import materialise

# The model inputs.
FEATURES = (
    "hist_orders",
    "hist_revenue",
    "hist_margin",
    "avg_order_value",
    "hist_recency_days",
    "customer_tenure_days",
    "total_events",
    "pricing_views",
    "cart_adds",
    "is_subscriber",
)


def cutoff_date(transactions: DataFrame, window_days: int = 180) -> Column:
    """The last order less the window (a scalar subquery)."""
    return transactions.agg(days_before(F.max("order_timestamp"), window_days)).scalar()


def split_periods(transactions: DataFrame, window_days: int = 180) -> DataFrame:
    """Mark each order as observation (up to the cutoff) or performance (after it)."""
    observed = F.col("order_timestamp") <= cutoff_date(transactions, window_days)
    return transactions.withColumn(
        "period", F.when(observed, "observation").otherwise("performance")
    )


def order_features(transactions: DataFrame, window_days: int = 180) -> DataFrame:
    """History up to the cutoff and revenue after it, in one pass over the orders."""
    cutoff = cutoff_date(transactions, window_days)
    before = F.col("order_timestamp") <= cutoff

    def past(column: str) -> Column:
        return F.when(before, F.col(column))

    grouped = (
        transactions.where(F.col(CUSTOMER).isNotNull())
        .groupBy(CUSTOMER)
        .agg(
            F.countDistinct(past("order_id")).cast("int").alias("hist_orders"),
            exact_sum(past("revenue")).alias("hist_revenue"),
            exact_sum(past("gross_margin")).alias("hist_margin"),
            F.count(past("revenue")).alias("_priced"),
            F.max(past("order_timestamp")).alias("last_order_date"),
            F.min(past("order_timestamp")).alias("first_order_date"),
            exact_sum(F.when(~before, F.col("revenue"))).alias("future_revenue"),
        )
    )
    return grouped.select(
        CUSTOMER,
        "hist_orders",
        "hist_revenue",
        "hist_margin",
        F.when(F.col("_priced") > 0, F.col("hist_revenue") / F.col("_priced")).alias("avg_order_value"),
        "last_order_date",
        "first_order_date",
        whole_days(F.col("last_order_date"), cutoff).alias("hist_recency_days"),
        whole_days(F.col("first_order_date"), cutoff).alias("customer_tenure_days"),
        "future_revenue",
    )


def history_features(transactions: DataFrame, window_days: int = 180) -> DataFrame:
    """Customers with an order up to the cutoff."""
    return (
        order_features(transactions, window_days)
        .where(F.col("hist_orders") > 0)
        .drop("future_revenue")
    )


def engagement_features(
    events: DataFrame, transactions: DataFrame, window_days: int = 180
) -> DataFrame:
    """Event counts up to the cutoff."""
    cutoff = cutoff_date(transactions, window_days)
    return (
        dated(events, high=cutoff)
        .where(F.col(CUSTOMER).isNotNull())
        .where(F.col("event_timestamp") <= cutoff)
        .groupBy(CUSTOMER)
        .agg(
            F.count("event_id").cast("int").alias("total_events"),
            F.count_if(F.col("event_type") == "pricing_view").cast("int").alias("pricing_views"),
            F.count_if(F.col("event_type") == "add_to_cart").cast("int").alias("cart_adds"),
        )
    )


def future_revenue(transactions: DataFrame, window_days: int = 180) -> DataFrame:
    """The target: revenue of each customer after the cutoff."""
    return (
        transactions.where(F.col(CUSTOMER).isNotNull())
        .where(F.col("order_timestamp") > cutoff_date(transactions, window_days))
        .groupBy(CUSTOMER)
        .agg(exact_sum(F.col("revenue")).alias("future_revenue"))
    )


def extract_features(
    transactions: DataFrame, profiles: DataFrame, events: DataFrame, window_days: int = 180
) -> DataFrame:
    """Model inputs and target for every profile; gaps become 0, a missing recency 999."""
    joined = (
        profiles.select(CUSTOMER, "subscription_status")
        .join(order_features(transactions, window_days), CUSTOMER, "left")
        .join(engagement_features(events, transactions, window_days), CUSTOMER, "left")
    )
    gaps = {name: 0 for name in (*FEATURES[:-1], "future_revenue")} | {"hist_recency_days": NEVER}
    subscriber = F.coalesce((F.col("subscription_status") == "active").cast("int"), F.lit(0))
    return (
        joined.withColumn("is_subscriber", subscriber)
        .fillna(gaps)
        .select(CUSTOMER, *FEATURES, "future_revenue")
    )


def train_test(df: DataFrame, id_col: str = CUSTOMER, train_pct: int = 75) -> DataFrame:
    """Mark a stable train/test split by the hash of the id."""
    return df.withColumn("is_train", hash_bucket(F.col(id_col)) < train_pct)


def assemble(df: DataFrame, features: tuple[str, ...] | list[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def train(features: DataFrame, iterations: int = 100) -> GBTRegressionModel:
    """Fit the regressor on the training part."""
    rows = assemble(features.where("is_train"), FEATURES).select("features", "future_revenue")
    return GBTRegressor(
        labelCol="future_revenue", maxIter=iterations, stepSize=0.05, maxDepth=4, seed=42
    ).fit(rows)


def predict(model: GBTRegressionModel, features: DataFrame) -> DataFrame:
    """Add the prediction, never below zero and unrounded."""
    scored = model.transform(assemble(features, FEATURES))
    value = F.greatest(F.lit(0.0), F.col("prediction"))
    return scored.withColumn("raw_cltv", value).drop("features", "prediction")


def deciles(df: DataFrame, score: str, out: str, id_col: str = CUSTOMER) -> DataFrame:
    """Decile 1-10 of the score by first-rank."""
    return quantile_buckets(materialise(df, "scored"), id_col, {out: F.col(score)}, 10)


def regression_metrics(actual: str, predicted: str) -> list[Column]:
    """Aggregates: mean absolute error, root mean squared error and R squared."""
    y, p = F.col(actual), F.col(predicted)
    residual = F.sum(F.pow(y - p, F.lit(2)))
    spread = F.var_pop(y) * F.count(y)
    return [
        round_half_up(F.avg(F.abs(y - p)), 2).alias("mae"),
        round_half_up(F.sqrt(residual / F.count(y)), 2).alias("rmse"),
        round_half_up(F.when(spread > 0, 1 - residual / spread), 3).alias("r2"),
    ]


def top_decile_share(actual: str, decile: str) -> Column:
    """Aggregate: percent of the actual revenue that falls in the top predicted decile."""
    total = exact_sum(F.col(actual))
    top = F.coalesce(exact_sum(F.when(F.col(decile) == 10, F.col(actual))), F.lit(0.0))
    share = F.when(total > 0, top / total * 100).otherwise(0.0)
    return round_half_up(share, 1).alias("top_decile_actual_revenue_share_pct")


def mean_by_decile(df: DataFrame, score: str = "predicted_cltv", decile: str = "cltv_decile") -> DataFrame:
    mean = exact_sum(F.col(score)) / F.count(score)
    return df.groupBy(decile).agg(mean.alias(f"mean_{score}")).orderBy(decile)


def train_and_evaluate(
    features: DataFrame, iterations: int = 100
) -> tuple[DataFrame, DataFrame]:
    """Scores with deciles for everybody, and the metrics of the test part."""
    split = materialise(train_test(features), "cltv")
    return evaluate(train(split, iterations), split)


def evaluate(model: GBTRegressionModel, split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores with deciles for everybody by a fitted model, and its metrics on the test part."""
    predicted = materialise(predict(model, split), "cltv-scored")
    test = deciles(predicted.where("NOT is_train"), "raw_cltv", "pred_decile")
    metrics = test.agg(
        *regression_metrics("future_revenue", "raw_cltv"),
        top_decile_share("future_revenue", "pred_decile"),
    )
    rounded = predicted.select(CUSTOMER, round_half_up("raw_cltv", 2).alias("predicted_cltv"))
    return deciles(rounded, "predicted_cltv", "cltv_decile"), metrics
