"""The rows that state is derived from, state items, changes between two states, contradictions, stale items, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from continuo.functions import text as T
from continuo.operators.state import DOD

#: The newest rows that state looks at, those of an earlier time, how many of the former in governed
#: order it is derived from, and how many of each kind it keeps.
NEWEST_ROWS, EARLIER_ROWS, STATE_ROWS = 480, 240, 160
STATE_LIMITS = {"objective": 1, "user_request": 4, "constraint": 4, "project_dod": 6, "mission_dod": 6, "session_dod": 6, "pending_item": 6, "completed_item": 6, "blocker": 4, "completion_claim": 3}
#: A health report's rows, and what of a state can be stale.
HEALTH_ROWS, STALE_DAYS = 240, 30


def state_text() -> Column:
    """Normal form of the first of summary, detail and title that is not empty."""
    return T.normalize_state(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("summary", "detail", "title")]))


def leading(items: DataFrame, keys: list[str], most: int, *order) -> DataFrame:
    """The first ``most`` rows of each group; a window limit runs before the shuffle, so hot groups stay small."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return items.withColumn("__rn", F.row_number().over(ranked)).where(F.col("__rn") <= most).drop("__rn")


def governed(observations: DataFrame, key: str, first: Column | None = None, most: int = STATE_ROWS) -> DataFrame:
    """The rows of each group that state is derived from, with ``pos``: of the newest ones the oldest first.

    Rows where ``first`` holds lead; ids count as texts.
    """
    rows = observations.where(F.col("type").isin(*STATE_LIMITS))
    rows = leading(rows, [key], NEWEST_ROWS, F.desc("updated_at"), F.desc("id"))
    lead = F.when(F.lit(False) if first is None else first, 0).otherwise(1)
    order = Window.partitionBy(key).orderBy(lead, "updated_at", F.col("id").cast("string"))
    return rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= most)


def earlier(observations: DataFrame, key: str, before: Column | int) -> DataFrame:
    """The rows of the state at an earlier time: the newest first, as no governance orders them."""
    rows = observations.where(F.col("type").isin(*STATE_LIMITS) & (F.col("updated_at") < before))
    order = Window.partitionBy(key).orderBy(F.desc("updated_at"), F.desc("id"))
    return rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= EARLIER_ROWS)


def state_items(rows: DataFrame, key: str) -> DataFrame:
    """key, type, pos, id, summary, updated_at, normalized: of each kind the leading texts that state keeps.

    Greedy fuzzy dedupe in the order of ``pos``: a text stays unless it matches one kept before, as many as STATE_LIMITS
    says, so joins between kinds stay small. Matching is not transitive, so each round keeps the first text left of
    a kind and drops what matches it. rows: see ``governed`` and ``earlier``.
    """
    rows = rows.withColumn("normalized", state_text()).where("normalized <> ''")
    distinct = rows.groupBy(key, "type", "normalized").agg(F.min(F.struct("pos", "id", "summary", "updated_at")).alias("x")).select(key, "type", "normalized", "x.*")
    limits = F.create_map(*[F.lit(v) for pair in STATE_LIMITS.items() for v in pair])
    so_far = Window.partitionBy(key, "type").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = distinct.withColumn("kept", F.lit(False))
    for k in range(1, max(STATE_LIMITS.values()) + 1):
        left = left.withColumn("first", F.first(F.when(~F.col("kept"), F.col("normalized")), ignorenulls=True).over(so_far))
        left = left.withColumn("kept", F.col("kept") | (F.col("first") == F.col("normalized")))
        left = left.where(F.col("kept") | ((limits[F.col("type")] > k) & ~T.state_matches(F.col("first"), F.col("normalized"))))
    return left.where("kept").drop("kept", "first")


def _group() -> Column:
    return F.when(F.col("type").isin(*DOD), "dod").when(F.col("type") == "pending_item", "pending").otherwise(F.col("type"))


def watched(items: DataFrame, open_items: DataFrame, key: str) -> DataFrame:
    """key, part, id, summary, normalized of what a change report compares: open items, and constraints."""
    columns = [key, _group().alias("part"), "id", "summary", "normalized"]
    return open_items.select(*columns).unionByName(items.where("type = 'constraint'").select(*columns))


def delta(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """key, part, change, id, summary: watched items of one state that match none of the same part in the other."""
    def missing(left: DataFrame, right: DataFrame, change: str) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        meets = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.part") == F.col("b.part")) & T.state_matches(F.col("a.normalized"), F.col("b.normalized"))
        return a.join(b, meets, "left_anti").select(key, "part", F.lit(change).alias("change"), "id", "summary")

    return missing(current, previous, "added").unionByName(missing(previous, current, "removed"))


def objective_changed(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """key, changed: whether the objectives (key, objective) of two states differ; groups without any are left out."""
    both = current.join(previous.withColumnRenamed("objective", "before"), key, "full")
    normal = lambda c: T.normalize_state(F.coalesce(c, F.lit("")))
    return both.select(key, (~T.state_matches(normal("objective"), normal("before"))).alias("changed"))


def contradictions(items: DataFrame, open_items: DataFrame, checked: DataFrame, key: str) -> DataFrame:
    """key, kind, left_text, right_text: open pending items and blockers that a completed text matches, each with the
    first such text, and a claim beside what speaks against it. checked: see ``state.completion_check``."""
    a, b = open_items.where("type in ('pending_item', 'blocker')").alias("a"), items.where("type = 'completed_item'").alias("b")
    meets = (F.col(f"a.{key}") == F.col(f"b.{key}")) & T.state_matches(F.col("a.normalized"), F.col("b.normalized"))
    kind = F.when(F.col("a.type") == "blocker", "blocker_vs_completed").otherwise("pending_vs_completed")
    pairs = a.join(b, meets).select(F.col(f"a.{key}").alias(key), kind.alias("kind"), F.col("a.pos").alias("at"), F.col("a.summary").alias("left_text"), F.struct("b.pos", "b.summary").alias("b"))
    pairs = pairs.groupBy(key, "kind", "at", "left_text").agg(F.min("b").alias("b")).select(key, "kind", "left_text", F.col("b.summary").alias("right_text"))
    mismatch = checked.where("closure_mismatch").select(key, F.lit("closure_mismatch").alias("kind"), F.lit("completion_claim").alias("left_text"), F.col("reasons").alias("right_text"))
    return pairs.unionByName(mismatch)


def stale(items: DataFrame, open_items: DataFrame, key: str, now: int, days: int = STALE_DAYS) -> DataFrame:
    """key, kind, summary, updated_at of open items and constraints not touched for more than ``days``; items without time are never stale."""
    kind = F.when(F.col("type").isin(*DOD), "dod_missing").otherwise(F.col("type")).alias("kind")
    columns = [key, kind, "summary", "updated_at"]
    rows = open_items.select(*columns).unionByName(items.where("type = 'constraint'").select(*columns))
    return rows.where(F.col("updated_at") < now - days * 86_400)


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """key, type, normalized, n, ids, latest: equal texts of one kind among a group's first rows, by their place."""
    rows = rows.where(F.col("pos") <= HEALTH_ROWS).withColumn("normalized", state_text()).where("normalized <> ''")
    ids = F.array_sort(F.collect_list(F.struct("pos", "id", "summary")))  # HEALTH_ROWS a group at most
    found = rows.groupBy(key, "type", "normalized").agg(F.count("*").alias("n"), ids.alias("xs")).where("n > 1")
    return found.select(key, "type", "normalized", "n", F.col("xs.id").alias("ids"), F.col("xs")[0]["summary"].alias("latest"))


def repairs(copies: DataFrame, rows: DataFrame, stale_items: DataFrame, key: str, protected: DataFrame) -> DataFrame:
    """key, repair_kind, id, reason: what archiving would touch. Of equal texts all but the first, and what has a stale text.

    protected: id of rows that are never archived. One row per id, so no list grows with a group.
    """
    more = copies.select(key, F.lit("archive_duplicate_observations").alias("repair_kind"), F.col("latest").alias("reason"), F.explode(F.slice("ids", F.lit(2), F.size("ids") - 1)).alias("id"))
    old = rows.join(stale_items.select(key, "summary").distinct(), [key, "summary"], "left_semi").select(key, F.lit("archive_stale_open_items").alias("repair_kind"), F.lit("stale_open_items").alias("reason"), "id").distinct()
    return more.unionByName(old).join(protected.select("id"), "id", "left_anti").select(key, "repair_kind", "id", "reason")


def review_kinds(contradictory: DataFrame, missing: DataFrame, key: str) -> DataFrame:
    """key, repair_kind, reason of what only people can mend."""
    reason = F.lit("manual_review_required").alias("reason")
    against = contradictory.select(key, F.lit("review_contradictions").alias("repair_kind"), reason)
    gaps = missing.where("dod_missing > 0").select(key, F.lit("review_dod_gaps").alias("repair_kind"), reason)
    return against.unionByName(gaps).distinct()


def without_repaired(observations: DataFrame, repaired: DataFrame) -> DataFrame:
    """Repairs hide rows and delete none."""
    return observations.join(repaired.select("id"), "id", "left_anti")
