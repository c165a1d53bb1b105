"""Campaign approvals, activations and the audit trail, as set operations on tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.functions.columns import dated
from clientele.functions.privacy import mask_text
from clientele.operators.rfm import CUSTOMER
from clientele.sources.scratch import materialise

APPROVAL_COLUMNS = (
    "nonce",
    "campaign_name",
    "audience_id",
    "channel",
    "approved_by",
    "issued_at",
    "expires_at",
    "consumed_at",
    "consumed_by",
)


def upsert_approvals(registry: DataFrame, issued: DataFrame) -> DataFrame:
    """Insert or replace by nonce; of several in one batch the newest counts, unconsumed."""
    fresh = issued.withColumns(
        {
            "consumed_at": F.lit(None).cast("timestamp"),
            "consumed_by": F.lit(None).cast("string"),
            "_batch": F.lit(1),
        }
    )
    both = registry.withColumn("_batch", F.lit(0)).unionByName(fresh)
    fields = [F.col(name) for name in APPROVAL_COLUMNS if name != "nonce"]
    order = F.struct("_batch", "issued_at", "expires_at", "approved_by")
    newest = both.groupBy("nonce").agg(F.max_by(F.struct(*fields), order).alias("_newest"))
    return newest.select("nonce", "_newest.*").select(*APPROVAL_COLUMNS)


def newest_approvals(issued: DataFrame) -> DataFrame:
    """The newest approval of every nonce in an append-only list."""
    fields = [F.col(name) for name in APPROVAL_COLUMNS if name != "nonce"]
    order = F.struct("issued_at", "expires_at", "approved_by")
    newest = issued.groupBy("nonce").agg(F.max_by(F.struct(*fields), order).alias("_newest"))
    return newest.select("nonce", "_newest.*").select(*APPROVAL_COLUMNS)


def first_claimed(registry: DataFrame, claims: DataFrame) -> DataFrame:
    """``(nonce, _claim)``: the first claim on every approval since its issue, of those made at once the smallest request."""
    issued = registry.select("nonce", "issued_at")
    order = F.struct("claimed_at", "request_id", "requested_at", "requested_by")
    return (
        claims.join(issued, "nonce").where(F.col("requested_at") >= F.col("issued_at")).groupBy("nonce").agg(F.min(order).alias("_claim"))
    )


def with_claims(registry: DataFrame, claims: DataFrame) -> DataFrame:
    """The registry with the first claim since its issue as the consumption of each approval."""
    return registry.join(first_claimed(registry, claims), "nonce", "left").select(
        *[c for c in APPROVAL_COLUMNS if not c.startswith("consumed")],
        F.coalesce("consumed_at", "_claim.requested_at").alias("consumed_at"),
        F.coalesce("consumed_by", "_claim.requested_by").alias("consumed_by"),
    )


def without_lost_claims(decided: DataFrame, registry: DataFrame, claims: DataFrame) -> DataFrame:
    """Decisions after the claims were appended: a success whose claim is not the first one is a replay."""
    won = first_claimed(registry, claims).select(F.col("_claim.request_id").alias("request_id"), F.lit(True).alias("_won"))
    lost = (F.col("status") == "SUCCESS") & F.col("_won").isNull()
    return decided.join(won, "request_id", "left").select(
        *[
            F.when(lost, F.lit(value)).otherwise(F.col(c)).alias(c) if (value := {"status": "REJECTED", "reason": "ALREADY_CONSUMED"}.get(c)) else c
            for c in decided.columns
        ]
    )


def claims(decided: DataFrame) -> DataFrame:
    """What the successful requests claim."""
    return decided.where(F.col("status") == "SUCCESS").select("nonce", "request_id", "requested_by", "requested_at")


def draft_campaigns(
    requests: DataFrame, audiences: DataFrame, ttl_minutes: int = 60
) -> DataFrame:
    """Draft plans waiting for approval; the size comes from the audience table."""
    return requests.join(audiences.select("audience_id", "audience_size"), "audience_id", "left").select(
        "campaign_name",
        "audience_id",
        "channel",
        F.col("message_objective").alias("objective"),
        F.col("offer_discount").alias("offer"),
        F.concat(F.col("frequency_cap").cast("string"), F.lit(" touches / week")).alias("frequency_cap"),
        F.coalesce("audience_size", F.lit(0)).alias("audience_size"),
        F.lit("PENDING_HUMAN_APPROVAL").alias("approval_status"),
        (F.col("requested_at") + F.make_dt_interval(mins=F.lit(ttl_minutes))).alias("token_expires_at"),
    )


def gate_reason() -> Column:
    """The first check an activation request fails, or null."""
    return (
        F.when(F.col("_nonce").isNull(), "NOT_REGISTERED")
        .when(F.col("expires_at") < F.col("requested_at"), "EXPIRED")
        .when(~F.col("campaign_name").eqNullSafe(F.col("_campaign")), "SCOPE_CAMPAIGN")
        .when(~F.col("audience_id").eqNullSafe(F.col("_audience")), "SCOPE_AUDIENCE")
        .when(~F.col("channel").eqNullSafe(F.col("_channel")), "SCOPE_CHANNEL")
        .when(F.col("_known").isNull(), "UNKNOWN_AUDIENCE")
        .when(~F.col("_status").eqNullSafe(F.lit("COMPLIANT")), "AUDIENCE_REJECTED")
    )


def check_requests(requests: DataFrame, registry: DataFrame, audiences: DataFrame) -> DataFrame:
    """Each request with the approval it names and ``gate_reason``, null when it passes.

    ``audiences`` are the definitions, ``(audience_id, status)`` with one row per id.
    """
    definitions = audiences.select(
        F.col("audience_id").alias("_known"), F.col("status").alias("_status")
    )
    approvals = registry.select(
        F.col("nonce").alias("_nonce"),
        F.col("campaign_name").alias("_campaign"),
        F.col("audience_id").alias("_audience"),
        F.col("channel").alias("_channel"),
        "approved_by",
        "expires_at",
        "consumed_at",
    )
    return (
        requests.join(approvals, F.col("nonce") == F.col("_nonce"), "left")
        .join(definitions, F.col("audience_id") == F.col("_known"), "left")
        .withColumn("gate_reason", gate_reason())
        .drop("_nonce", "_campaign", "_audience", "_channel", "_known", "_status")
    )


def first_claims(checked: DataFrame) -> DataFrame:
    """The earliest passing request of every unconsumed nonce."""
    claim = F.min(F.struct("requested_at", "request_id")).alias("_first")
    return (
        checked.where(F.col("gate_reason").isNull() & F.col("consumed_at").isNull())
        .groupBy("nonce")
        .agg(claim)
        .select(F.col("_first.request_id").alias("request_id"), F.lit(True).alias("_claims"))
    )


def decide_requests(requests: DataFrame, registry: DataFrame, audiences: DataFrame) -> DataFrame:
    """Status and reason per request: a nonce serves one request, later ones are replays.

    The claims are joined on the request id, which is unique, so a nonce that a large
    share of all requests names does not skew the join.
    """
    checked = materialise(check_requests(requests, registry, audiences), "requests")
    reason = (
        F.when(F.col("gate_reason").isNotNull(), F.col("gate_reason"))
        .when(F.col("_claims"), F.lit(None).cast("string"))
        .otherwise("ALREADY_CONSUMED")
    )
    return (
        checked.join(first_claims(checked), "request_id", "left")
        .withColumn("reason", reason)
        .withColumn("status", F.when(F.col("reason").isNull(), "SUCCESS").otherwise("REJECTED"))
        .drop("gate_reason", "_claims")
    )


def consume_approvals(registry: DataFrame, decided: DataFrame) -> DataFrame:
    """The registry after the successful requests have consumed their nonces."""
    used = decided.where(F.col("status") == "SUCCESS").select(
        "nonce", F.col("requested_at").alias("_used_at"), F.col("requested_by").alias("_used_by")
    )
    return (
        registry.join(used, "nonce", "left")
        .withColumns(
            {
                "consumed_at": F.coalesce("consumed_at", "_used_at"),
                "consumed_by": F.coalesce("consumed_by", "_used_by"),
            }
        )
        .select(*APPROVAL_COLUMNS)
    )


def activations(decided: DataFrame, audiences: DataFrame) -> DataFrame:
    """The activation log rows of the successful requests."""
    payload = F.to_json(
        F.struct("nonce", F.col("channel").alias("target_channel"), "approved_by")
    )
    return (
        decided.where(F.col("status") == "SUCCESS")
        .join(audiences.select("audience_id", "audience_size"), "audience_id", "left")
        .select(
            F.concat(F.lit("ACT_"), F.upper(F.md5("request_id"))).alias("activation_id"),
            "audience_id",
            "campaign_name",
            F.col("channel").alias("target_channel"),
            "approved_by",
            F.lit("APPROVED_AND_ACTIVATED").alias("approval_status"),
            F.col("requested_at").alias("activated_at"),
            F.coalesce("audience_size", F.lit(0)).alias("audience_size"),
            payload.alias("payload"),
        )
    )


def latest_activations(log: DataFrame, rows: int = 5) -> DataFrame:
    return (
        log.orderBy(F.desc("activated_at"), "activation_id")
        .limit(rows)
        .select("campaign_name", "target_channel", "audience_size", "approval_status")
    )


def audit_rows(decided: DataFrame, session_id: str, tool_name: str = "activate_campaign") -> DataFrame:
    """One audit row per decision, accepted or not."""
    accepted = F.col("status") == "SUCCESS"
    return decided.select(
        F.concat(F.lit("LOG_"), F.upper(F.md5("request_id"))).alias("log_id"),
        F.lit(session_id).alias("session_id"),
        F.when(accepted, "campaign_activation").otherwise("activation_attempt").alias("action_type"),
        F.lit(tool_name).alias("tool_name"),
        mask_text(F.col("campaign_name")).alias("request_prompt"),
        F.when(accepted, "APPROVED_BY_HUMAN").otherwise("BLOCKED_BY_GOVERNANCE").alias("governance_status"),
        F.to_json(F.struct("reason", "campaign_name", "audience_id", "channel")).alias("details"),
        F.col("requested_at").alias("timestamp"),
    )


def audit_rollup(log: DataFrame) -> DataFrame:
    return log.groupBy("governance_status").agg(F.count("*").alias("records"))


def capped_customers(touches: DataFrame, as_of: datetime | Column, cap: int = 2, days: int = 7) -> DataFrame:
    """Customers with ``cap`` or more touches in the trailing days up to ``as_of``."""
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    start = moment - F.make_dt_interval(F.lit(days))
    return (
        dated(touches, start, moment)
        .where((F.col("event_timestamp") > start) & (F.col("event_timestamp") <= moment))
        .groupBy(CUSTOMER)
        .agg(F.count("*").alias("recent_touches"))
        .where(F.col("recent_touches") >= cap)
    )


def within_cap(members: DataFrame, touches: DataFrame, as_of: datetime | Column, cap: int = 2, days: int = 7) -> DataFrame:
    """Members that may still be contacted this week."""
    return members.join(capped_customers(touches, as_of, cap, days), CUSTOMER, "left_anti")
