"""Rollups and metrics. Each side is aggregated before it is joined, so nothing fans out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def project_rollup(observations: DataFrame) -> DataFrame:
    return observations.groupBy("project_key").agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("observations"), F.count(F.when((F.col("type") == "decision") & (F.col("status") == "active"), 1)).alias("active_decisions"), F.max("updated_at").alias("updated_at"))


def session_list(turns: DataFrame, observations: DataFrame) -> DataFrame:
    by_turn = turns.groupBy("session_id").agg(F.count("*").alias("turns"), F.max("captured_at").alias("last_at"), F.min_by("text", F.struct("captured_at", "turn")).alias("first_text"))
    by_observation = observations.groupBy("session_id").agg(F.count("*").alias("observations"))
    return by_turn.join(by_observation, "session_id", "left").withColumn("observations", F.coalesce("observations", F.lit(0)))


def sync_metrics(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("events"), F.sum(F.col("skipped").cast("long")).alias("skipped"), F.round(F.avg("compression_ratio"), 3).alias("ratio"), F.round(F.avg("build_ms"), 3).alias("build_ms"), F.max("generated_at").alias("latest"))


def sync_by_budget(events: DataFrame) -> DataFrame:
    return events.groupBy("budget").agg(F.count("*").alias("events"), F.round(F.avg("compression_ratio"), 3).alias("ratio"))


def closure_reasons(events: DataFrame) -> DataFrame:
    reason = lambda bit, name: F.when(F.col("k").bitwiseAND(bit) > 0, name)
    reasons = F.array_compact(F.array(reason(1, "pending_items_open"), reason(2, "blockers_open"), reason(4, "dod_incomplete"), reason(8, "missing_evidence")))
    return events.select("budget", F.explode(reasons).alias("reason")).groupBy("budget", "reason").agg(F.count("*").alias("n"))


def sync_summary(rows: DataFrame) -> DataFrame:
    """One row over sync events: how many, synced, skipped, ratios, times; sums over none are null."""
    skipped = F.col("skipped").cast("int")
    return rows.agg(F.count("*").alias("events"), F.sum(1 - skipped).alias("synced"), F.sum(skipped).alias("skipped"), F.round(F.avg("compression_ratio"), 3).alias("ratio"), F.round(F.avg("build_ms"), 2).alias("build_ms"), F.max("build_ms").alias("max_build_ms"), F.max("at").alias("latest"))


def closure_metrics(rows: DataFrame) -> DataFrame:
    """One row over closure events (event_kind, passed, reasons): totals, and how often each reason was given."""
    sums = rows.agg(F.count("*").alias("events"), F.count_if(F.col("event_kind") == "mismatch").alias("mismatches"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    each = rows.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    counts = each.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reason_counts"))  # a few reasons
    return sums.join(F.broadcast(counts))  # one row each


def latest_sync(events: DataFrame) -> DataFrame:
    """Latest successful event of each project."""
    return events.where("not skipped").groupBy("project_id").agg(F.max(F.struct("generated_at", "event_id")).alias("x")).select("project_id", "x.event_id", "x.generated_at")


def baseline_sync(events: DataFrame, k_change: int = 50) -> DataFrame:
    """Newest successful event strictly before the project's latest change (an event with k of ``k_change`` or more)."""
    change = events.where(F.col("k") >= k_change).groupBy("project_id").agg(F.max("generated_at").alias("changed_at"))
    before = events.where("not skipped").join(change, "project_id").where("generated_at < changed_at")
    return before.groupBy("project_id", "changed_at").agg(F.max(F.struct("generated_at", "event_id")).alias("x")).select("project_id", "changed_at", F.col("x.event_id").alias("event_id"))


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert-or-ignore: of each key the row that came first."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def token_stats(observations: DataFrame) -> DataFrame:
    chars = F.sum(F.length("detail"))
    packed = F.sum(F.length("summary"))
    return observations.groupBy("project_key").agg(chars.alias("source_chars"), packed.alias("pack_chars"), F.greatest(F.lit(1), F.ceil(chars / 4)).cast("long").alias("source_tokens"), F.greatest(F.lit(1), F.ceil(packed / 4)).cast("long").alias("pack_tokens"))


def upserted(rows: DataFrame, key: str, sticky: str) -> DataFrame:
    """One row a key: first and last time, the newest ``sticky`` that is not null, the highest version (1 at least).

    rows: key, ts, event_id, ``sticky``, version. A fold by aggregates, so no key's rows are sorted or collected.
    """
    newest = F.max(F.when(F.col(sticky).isNotNull(), F.struct("ts", "event_id", sticky)))
    out = rows.groupBy(key).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), newest.alias("x"), F.max("version").alias("version"))
    return out.select(key, "first_seen", "last_seen", F.col(f"x.{sticky}").alias(sticky), F.greatest(F.lit(1), "version").cast("long").alias("schema_version"))
