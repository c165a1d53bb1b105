"""Exact global ranks, quantile buckets and running totals without a one-task sort.

A window without ``partitionBy`` moves every row to one task.  Here the rows are
range-partitioned on a unique order, sorted inside each partition, and numbered by
``monotonically_increasing_id`` (partition number in the upper bits, position in the
lower 33).  The sorted table is written once, so the partition sizes and the rows
always agree.  Only one number per partition, or one row per bucket edge, reaches
the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from clientele.sources.scratch import materialise

_POSITION_BITS = 33
_SLOT = "_slot"


def range_partitions(spark: SparkSession) -> int:
    """Partitions for an explicit range split: the session's setting, or all cores if more."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(wanted, spark.sparkContext.defaultParallelism)


def _sorted_table(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    partitions = range_partitions(df.sparkSession)
    ordered = df.repartitionByRange(partitions, *order_by).sortWithinPartitions(*order_by)
    return materialise(ordered.withColumn(_SLOT, F.monotonically_increasing_id()), "ordered")


def _partition() -> Column:
    return F.shiftright(F.col(_SLOT), _POSITION_BITS)


def _position() -> Column:
    return F.col(_SLOT).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))


def _partition_sums(table: DataFrame, sums: dict[str, Column]) -> list[Row]:
    """One row per range partition, in order."""
    totals = [F.sum(value).alias(name) for name, value in sums.items()]
    return sorted(
        table.groupBy(_partition().alias("_part")).agg(*totals).collect(), key=lambda row: row["_part"]
    )


def _offsets(df: DataFrame, parts: list[Row], names: Sequence[str]) -> DataFrame:
    """Totals of all earlier partitions; as many rows as there are partitions."""
    running = {name: 0 for name in names}
    rows = []
    for part in parts:
        rows.append((part["_part"], *(running[name] for name in names)))
        for name in names:
            running[name] += part[name] or 0
    fields = ", ".join(f"_before_{name} bigint" for name in names)
    return df.sparkSession.createDataFrame(rows, f"_part bigint, {fields}")


def global_rank(df: DataFrame, order_by: Sequence[str], name: str = "rank") -> DataFrame:
    """Number all rows 1..n in the given order, which must be unique."""
    table = _sorted_table(df, order_by)
    parts = _partition_sums(table, {"rows": F.lit(1)})
    offsets = F.broadcast(_offsets(df, parts, ["rows"]))
    return (
        table.withColumn("_part", _partition())
        .join(offsets, "_part")
        .select(*df.columns, (F.col("_before_rows") + _position() + 1).alias(name))
    )


def running_totals(df: DataFrame, order_by: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Add the inclusive running total of each bigint column along a unique order."""
    table = _sorted_table(df, order_by)
    parts = _partition_sums(table, {out: F.col(source) for out, source in sums.items()})
    offsets = F.broadcast(_offsets(df, parts, list(sums)))
    inside = Window.partitionBy("_part").orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, 0)
    return (
        table.withColumn("_part", _partition())
        .join(offsets, "_part")
        .select(
            *df.columns,
            *[
                (F.sum(source).over(inside) + F.col(f"_before_{out}")).alias(out)
                for out, source in sums.items()
            ],
        )
    )


def rows_at_ranks(
    df: DataFrame, order_by: Sequence[str], ranks: Callable[[int], Sequence[int]]
) -> dict[int, Row]:
    """The rows standing at the ranks that ``ranks(n)`` asks for."""
    table = _sorted_table(df, order_by)
    parts = _partition_sums(table, {"rows": F.lit(1)})
    wanted = sorted(set(ranks(sum(part["rows"] for part in parts))))
    slots: dict[int, int] = {}
    before = 0
    for part in parts:
        for rank in wanted:
            if before < rank <= before + part["rows"]:
                slots[(part["_part"] << _POSITION_BITS) + rank - before - 1] = rank
        before += part["rows"]
    if not slots:
        return {}
    found = table.where(F.col(_SLOT).isin(list(slots))).collect()
    return {slots[row[_SLOT]]: row for row in found}


def after(key: Column, tie: Column, edge_key, edge_tie) -> Column:
    """True where (key, tie) sorts after the edge row; nulls sort first, as they do in a sort."""

    def greater(column: Column, edge) -> Column:
        return column.isNotNull() if edge is None else F.coalesce(column > F.lit(edge), F.lit(False))

    return greater(key, edge_key) | (key.eqNullSafe(F.lit(edge_key)) & greater(tie, edge_tie))


def first_rows(df: DataFrame, id_col: str, count: int, key: Column | None = None) -> DataFrame:
    """The first ``count`` rows by an ascending key, if given, and a unique id.

    A limit would pass through one task.  Only the row at the edge is looked up, and the others are
    compared with it in place.
    """
    if count <= 0:
        return df.where(F.lit(False))
    key = F.lit(0) if key is None else key
    ordered = df.select(key.alias("_key"), F.col(id_col).alias("_id"))
    edges = rows_at_ranks(ordered, ["_key", "_id"], lambda total: [count] if total > count else [])
    if not edges:
        return df
    return df.where(~after(key, F.col(id_col), edges[count]["_key"], edges[count]["_id"]))


def _tagged_keys(df: DataFrame, id_col: str, keys: dict[str, Column]) -> DataFrame:
    """One row per key and id: ``(_metric, _key, _id)``, so that all keys share one sort."""
    pairs = [
        F.struct(F.lit(i).alias("_metric"), key.cast("double").alias("_key"))
        for i, key in enumerate(keys.values())
    ]
    tagged = df.select(F.col(id_col).alias("_id"), F.explode(F.array(*pairs)).alias("_pair"))
    return tagged.select("_pair._metric", "_pair._key", "_id")


def first_ranks(df: DataFrame, id_col: str, keys: dict[str, Column]) -> DataFrame:
    """Rank 1..n of every row by each key, ties by id."""
    ranked = global_rank(_tagged_keys(df, id_col, keys), ["_metric", "_key", "_id"], "_rank")
    total = df.agg(F.count("*")).scalar()
    in_metric = F.col("_rank") - F.col("_metric") * total
    ranks = [
        F.max(F.when(F.col("_metric") == i, in_metric)).alias(name) for i, name in enumerate(keys)
    ]
    return ranked.groupBy(F.col("_id").alias(id_col)).agg(*ranks)


def quantile_buckets(
    df: DataFrame, id_col: str, keys: dict[str, Column], buckets: int
) -> DataFrame:
    """Add a 1..``buckets`` column per key: equal-sized buckets of the key's first-rank.

    Row ``rk`` of ``n`` falls in ``max(1, ceil(buckets * (rk - 1) / (n - 1)))``, ties by id.
    All keys share one sort; the rows themselves are then only compared with the
    ``buckets - 1`` edge rows of each key.  ``df`` is read twice: pass a written table.
    """
    names = list(keys)
    tagged = _tagged_keys(df, id_col, keys)

    def edge_rank(total: int, metric: int, bucket: int) -> int:
        rows = total // len(names)
        return metric * rows + bucket * (rows - 1) // buckets + 1

    totals: list[int] = []

    def wanted(total: int) -> list[int]:
        totals.append(total)
        if total == 0:
            return []
        return [edge_rank(total, m, b) for m in range(len(names)) for b in range(1, buckets)]

    edges = rows_at_ranks(tagged, ["_metric", "_key", "_id"], wanted)

    def bucket_of(metric: int, name: str) -> Column:
        if not totals[0]:
            return F.lit(1)
        key, tie = keys[name].cast("double"), F.col(id_col)
        steps = []
        for b in range(1, buckets):
            edge = edges[edge_rank(totals[0], metric, b)]
            steps.append(after(key, tie, edge["_key"], edge["_id"]).cast("int"))
        return reduce(lambda left, right: left + right, steps, F.lit(1))

    return df.withColumns({name: bucket_of(i, name) for i, name in enumerate(names)})
