"""The customer tables as Parquet folders, and the loads that fill them from the feeds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from clientele.functions.columns import DATE
from clientele.operators import identity, keyed, merging
from clientele.operators.rfm import CUSTOMER
from clientele.sources.feeds import conform
from clientele.sources.schemas import KEYS, TABLES, struct
from clientele.sources.scratch import materialise


def query(spark: SparkSession, sql: str) -> DataFrame:
    """Ad-hoc SQL over the registered views."""
    return spark.sql(sql)


def query_params(spark: SparkSession, sql: str, params: dict | list) -> DataFrame:
    """SQL with bound parameters, named (``:name``) or positional (``?``)."""
    return spark.sql(sql, args=params)


def register(df: DataFrame, name: str) -> None:
    """Make a frame visible to SQL."""
    df.createOrReplaceTempView(name)


# The time by whose date a fact table is laid out.
DATED = {
    "transaction_fact": "order_timestamp",
    "event_fact": "event_timestamp",
    "campaign_touchpoint": "event_timestamp",
}


def _findable(writer: DataFrameWriter) -> DataFrameWriter:
    """Write Parquet bloom filters of the customer, so that a look-up skips the row groups without them."""
    return writer.options(
        **{f"parquet.bloom.filter.enabled#{CUSTOMER}": "true", f"parquet.bloom.filter.adaptive.enabled#{CUSTOMER}": "true"}
    )


class Warehouse:
    """The tables below one folder.

    A table is a folder of numbered versions.  A version counts once its write is committed (Spark's
    ``_SUCCESS`` file), and the newest that counts is the table; a failing write leaves the table as
    it was.  The version before the newest is kept for readers that have begun with it.  Fact tables
    are laid out by date and sorted by time inside, and carry the date as a column to prune by.  Other tables
    of customers are laid out and sorted by customer.  All of both carry bloom filters of the customer, so
    a look-up of one customer reads few row groups.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root

    def _versions(self, name: str) -> list[int]:
        """The committed versions, oldest first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return []
        folders = [status.getPath() for status in store.listStatus(path)]
        marked = [f.getName() for f in folders if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
        return sorted(int(n.removeprefix("v")) for n in marked if n.startswith("v") and n[1:].isdigit())

    def path(self, name: str) -> str:
        """The folder of the newest version."""
        return f"{self.root}/{name}/v{self._versions(name)[-1]}"

    def read(self, name: str) -> DataFrame:
        schema = struct(TABLES[name])
        if name in DATED:
            schema = schema.add(DATE, "date")
        return self.spark.read.schema(schema).parquet(self.path(name))

    def of_customer(self, name: str, customer: str) -> DataFrame:
        """The rows of one customer."""
        return self.read(name).where(F.col(CUSTOMER) == F.lit(customer))

    def ensure_tables(self) -> None:
        """Create the tables that do not exist yet, empty."""
        for name, ddl in TABLES.items():
            if not self._versions(name):
                self._write(name, self.spark.createDataFrame([], struct(ddl)), f"{self.root}/{name}/v0", "errorifexists")

    def _write(self, name: str, df: DataFrame, path: str, mode: str) -> None:
        rows = conform(df, TABLES[name])
        if name not in DATED:
            if CUSTOMER in rows.columns:
                placed = rows.hint("rebalance", CUSTOMER).sortWithinPartitions(CUSTOMER)
                _findable(placed.write.mode(mode)).parquet(path)
            else:
                rows.write.mode(mode).parquet(path)
            return
        stamp = DATED[name]
        # Rebalancing brings a date together and still splits a date that holds a large share of the rows.
        dated = rows.withColumn(DATE, F.to_date(stamp)).hint("rebalance", DATE).sortWithinPartitions(DATE, stamp)
        _findable(dated.write.mode(mode)).partitionBy(DATE).parquet(path)

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """Full refresh as a new version; the content may come from the table itself."""
        versions = self._versions(name)
        number = versions[-1] + 1 if versions else 0
        # A version without its mark is what a failed write has left.
        self._write(name, df, f"{self.root}/{name}/v{number}", "overwrite")
        for old in versions[:-1]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/v{old}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return self.read(name)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        self._write(name, df, self.path(name), "append")
        return self.read(name)

    def upsert(self, name: str, rows: DataFrame, now: datetime) -> dict[str, int]:
        """Bring rows into a keyed table; the newest row of a key counts, wherever it comes from.

        Rows without a key, older ones of a key and those older than the stored row go to ``rejected_row``;
        rows equal to a stored one change nothing.  Of a dated table only the folders are rewritten whose
        rows change, so the same batch may be brought twice.  Returns how many rows came in and were rejected,
        and how many dates were rewritten.
        """
        key, newest = KEYS[name]
        given = conform(rows, TABLES[name])
        number = keyed.free_name(given, "_number")
        numbered = materialise(given.withColumn(number, F.monotonically_increasing_id()), "numbered")
        # Of both sides only the order travels; the newest rows are joined as they are smaller for a small batch.
        first = materialise(keyed.newest_numbers(numbered, key, newest, given.columns, number), "first")
        stored = conform(self.read(name), TABLES[name])
        held = stored.select(
            key, keyed.row_order(given, newest).alias("_stored"), keyed.content(given).alias("_stored_content"),
            F.col(newest).alias("_stored_time"),
        )
        # Of equal rows the stored one counts, which leaves its folder alone.
        state = F.when(F.col("_order") > F.col("_stored"), keyed.COMING).when(
            (F.col("_order") < F.col("_stored")) | (F.col("_content") != F.col("_stored_content")), keyed.STALE
        ).otherwise(keyed.SAME)
        met = held.join(first, key).select(F.col(number).alias(number), state.alias("_state"), "_stored_time")
        met = materialise(met, "met")
        told = numbered.join(first.select(number, F.lit(True).alias("_first")), number, "left").join(
            met.select(number, "_state"), number, "left"
        )
        reason = F.when(~keyed.has_key([key]), keyed.MISSING).when(F.col("_first").isNull(), keyed.REPEATED)
        told = told.select(*given.columns, F.coalesce(reason, "_state", F.lit(keyed.COMING)).alias("_told"))
        told = materialise(told.where(F.col("_told") != keyed.SAME), "told")
        coming = told.where(F.col("_told") == keyed.COMING).select(*given.columns)
        refused = told.where(F.col("_told") != keyed.COMING).withColumnRenamed("_told", "reason")
        found = told.agg(F.count_if(F.col("_told") == keyed.COMING).alias("n"), F.count("*").alias("m")).first()
        counts = {"coming": found["n"], "rejected": found["m"] - found["n"], "dates": 0}
        if counts["rejected"]:
            self.append("rejected_row", _rejected_rows(name, key, refused, now))
        if not counts["coming"]:
            return counts
        newer = coming.select(key)
        if name not in DATED:
            self.replace(name, stored.join(newer, key, "left_anti").unionByName(coming))
            return counts
        going = met.where(F.col("_state") == keyed.COMING).select(F.to_date("_stored_time").alias(DATE)).distinct()
        come = coming.select(F.to_date(DATED[name]).alias(DATE)).distinct()
        left_by, dates = ({r[0] for r in frame.collect()} for frame in (going, come))  # as many as days
        self._rewrite_dates(name, dates | left_by, left_by - dates, newer, key, coming)
        return counts | {"dates": len(dates | left_by)}

    def _rewrite_dates(self, name: str, dates: set, left_by: set, newer: DataFrame, key: str, coming: DataFrame) -> None:
        """Replace the folders of these dates by what they hold of other keys and the new rows.

        A dynamic overwrite puts new folders in place only once all are written, so it may read the old ones.
        ``left_by`` are dates that rows leave and none comes to.
        """

        def rest(of: set) -> DataFrame:
            touched = F.col(DATE).isin([d for d in of if d is not None])
            if None in of:
                touched = touched | F.col(DATE).isNull()
            return self.read(name).where(touched).join(newer, key, "left_anti")

        stays = {r[0] for r in rest(left_by).select(DATE).distinct().collect()} if left_by else set()
        path, stamp = self.path(name), DATED[name]
        content = conform(rest(dates), TABLES[name]).unionByName(coming).withColumn(DATE, F.to_date(stamp))
        ordered = content.hint("rebalance", DATE).sortWithinPartitions(DATE, stamp)
        writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        _findable(writer).partitionBy(DATE).parquet(path)
        for gone in left_by - stays:  # a date that lost its last row
            folder = f"{DATE}={'__HIVE_DEFAULT_PARTITION__' if gone is None else gone.isoformat()}"
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def clusters(self) -> merging.Clusters:
        return merging.Clusters(*(self.read(name) for name in merging.CLUSTER_TABLES))

    def merge_identities(self, links: DataFrame, threshold: float, entities: DataFrame | None = None) -> merging.Clusters:
        """Merge a batch of links into the stored clusters and return what it added.

        Absorbed roots are stored first: a batch that failed in between is merged again and ends alike.
        """
        added = merging.merge_links(self.clusters(), links, threshold, entities)
        for name, rows in reversed(list(zip(merging.CLUSTER_TABLES, added, strict=True))):
            self.append(name, rows)
        return added

    def register_all(self, names: list[str]) -> None:
        for name in names:
            register(self.read(name), name)


def _rejected_rows(name: str, key: str, rows: DataFrame, now: datetime) -> DataFrame:
    written = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    content = F.to_json(F.struct(*[c for c in rows.columns if c != "reason"]), written)
    return rows.select(
        F.lit(name).alias("table_name"), "reason", F.col(key).alias("row_key"), content.alias("content"),
        F.lit(now).cast("timestamp").alias("rejected_at"),
    )


def profile_rows(entities: DataFrame, mapping: DataFrame, now: datetime) -> DataFrame:
    stamp = F.lit(now).cast("timestamp")
    return identity.golden_records(entities, mapping).withColumn("updated_at", stamp)


def fact_rows(feed: DataFrame, mapping: DataFrame, table: str) -> DataFrame:
    """A feed in the shape of its table, keyed by the unified id."""
    return conform(identity.with_unified_id(feed, mapping), TABLES[table])


# Which feed fills which fact table.
FACTS = {
    "transaction_fact": "transactions",
    "event_fact": "events",
    "campaign_touchpoint": "touchpoints",
}


def consent_rows(consents: DataFrame, mapping: DataFrame) -> DataFrame:
    """One consent row per unified id; where entities disagree the newest answer counts."""
    flags = ("marketing_opt_in", "tracking_consent", "third_party_sharing", "do_not_track")
    order = F.struct("updated_at", "entity_id")
    newest = F.max_by(F.struct(*flags, "updated_at"), order).alias("_newest")
    return (
        identity.with_unified_id(consents, mapping)
        .where(F.col(CUSTOMER).isNotNull())
        .groupBy(CUSTOMER)
        .agg(newest)
        .select(CUSTOMER, "_newest.*")
    )


def upsert_feeds(warehouse: Warehouse, feeds: dict[str, DataFrame], mapping: DataFrame, now: datetime) -> dict[str, dict[str, int]]:
    """Bring a batch of the fact and consent feeds into the stored tables, by key."""
    done = {table: warehouse.upsert(table, fact_rows(feeds[feed], mapping, table), now) for table, feed in FACTS.items() if feed in feeds}
    if "consents" in feeds:
        done["consent_preference"] = warehouse.upsert("consent_preference", consent_rows(feeds["consents"], mapping), now)
    return done


def load_feeds(
    warehouse: Warehouse, feeds: dict[str, DataFrame], resolved: DataFrame, now: datetime
) -> None:
    """Fill the profile, identity, fact and consent tables."""
    mapping = identity.entity_map(resolved)
    stamp = F.lit(now).cast("timestamp")
    warehouse.replace("customer_profile", profile_rows(feeds["entities"], mapping, now))
    warehouse.replace("identity_map", identity.identity_map(resolved).withColumn("created_at", stamp))
    for table, feed in FACTS.items():
        warehouse.replace(table, fact_rows(feeds[feed], mapping, table))
    warehouse.replace("consent_preference", consent_rows(feeds["consents"], mapping))
