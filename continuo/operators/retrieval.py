"""Recency, search, dedupe, caps and ordering over observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from continuo.functions import text as T
from continuo.operators import search as search_language
from continuo.plans.scratch import cut
from continuo.plans.views import PROTECTED

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sessions that a collapsed row lists at most, the smallest ids first; their number is exact.
LISTED_SESSIONS = 100


def recent(observations: DataFrame, limit: int = 50) -> DataFrame:
    return observations.orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)


def like_search(observations: DataFrame, query: str) -> DataFrame:
    """Substring search over title, summary and detail without ASCII case; % and _ in the query are wildcards."""
    fold = lambda c: F.translate(c, _UPPER, _LOWER)
    asked = query.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\")  # a backslash stands for itself
    pattern = F.lit(f"%{asked}%")
    return observations.where(F.like(fold("title"), pattern) | F.like(fold("summary"), pattern) | F.like(fold("detail"), pattern))


def bm25(observations: DataFrame, query: str) -> DataFrame:
    """(id, rank) of the rows that meet a query of ``search.parse``, by one pass over their texts."""
    tree, phrases = search_language.parse(query)
    return search_language.ranked(cut(search_language.counts_in_texts(observations, phrases)), tree)


def search(observations: DataFrame, query: str, limit: int = 10, among: DataFrame | None = None, ranks: DataFrame | None = None) -> DataFrame:
    """Queries of the search language are ranked, others are searched as substrings; type priority leads.

    Word statistics are those of all rows; only hits ``among`` some (all by default) count towards the limit. ``ranks``:
    (id, rank) of a query of the language, where an index has them.
    """
    among = observations if among is None else among
    if not query.strip():
        return recent(among, limit).withColumn("rank", F.lit(None).cast("double"))
    return hits(observations, query, among, ranks).orderBy("priority", "rank", F.desc("updated_at"), "id").limit(limit)


def hits(observations: DataFrame, query: str, among: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """The rows among which the query is found, with rank; not limited."""
    parsed = search_language.parse(query)
    if parsed is None:
        return like_search(among, query).withColumn("rank", F.lit(0.0))
    if parsed[0] is None:
        return among.where("false").withColumn("rank", F.lit(0.0))
    return among.join(bm25(observations, query) if ranks is None else ranks, "id")


def with_fingerprint(observations: DataFrame) -> DataFrame:
    """Rows with the hash of their kind, status and texts; null where they have no text."""
    text = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("summary", "detail", "title")])
    return observations.withColumn("fingerprint", F.when(text != "", T.fingerprint(F.col("type"), F.col("status"), text)))


def _copy_key():
    return F.coalesce("fingerprint", F.concat(F.lit("id "), F.col("id").cast("string")))  # rows without text stay apart


def first_of_copies(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """Of rows with one fingerprint the first in order; rows without text all stay."""
    keyed = with_fingerprint(rows).withColumn("copy_key", _copy_key())
    return leading(keyed, [*keys, "copy_key"], *order).drop("copy_key")


def leading(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")


def dedupe(observations: DataFrame) -> DataFrame:
    """First row (newest) of each fingerprint with its group's count, sessions and latest time."""
    keyed = with_fingerprint(observations).withColumn("copy_key", _copy_key())
    groups = keyed.groupBy("copy_key").agg(F.max("id").alias("id"), F.max("fingerprint").alias("fingerprint"), F.count("*").alias("duplicate_count"), F.countDistinct("session_id").alias("sessions"), F.max("updated_at").alias("latest"))
    return groups.select("id", "fingerprint", "duplicate_count", "sessions", "latest")


def collapsed(found: DataFrame, *order) -> DataFrame:
    """The first row in order of each fingerprint, with duplicate_count, sessions, session_ids and latest of all its rows."""
    keyed = with_fingerprint(found).withColumn("copy_key", _copy_key())
    first = leading(keyed, ["copy_key"], *order)
    each = keyed.where("session_id is not null").groupBy("copy_key", "session_id").agg(F.count("*").alias("n"))
    few = each.withColumn("__rn", F.row_number().over(Window.partitionBy("copy_key").orderBy("session_id"))).where(F.col("__rn") <= LISTED_SESSIONS)
    listed = few.groupBy("copy_key").agg(F.array_sort(F.collect_list("session_id")).alias("session_ids"))
    groups = keyed.groupBy("copy_key").agg(F.count("*").alias("duplicate_count"), F.countDistinct("session_id").alias("sessions"), F.max("updated_at").alias("latest"))
    return first.join(groups, "copy_key").join(listed, "copy_key", "left").drop("copy_key")


def cap_per_session(observations: DataFrame, most: int = 8) -> DataFrame:
    """The ``most`` leading rows of each session, protected types first; rows without session are not capped."""
    order = Window.partitionBy("session_id").orderBy(F.when(F.col("type").isin(*PROTECTED), 0).otherwise(1), F.desc("updated_at"), F.desc("id"))
    capped = observations.where("session_id is not null").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).drop("rn")
    return capped.unionByName(observations.where("session_id is null"))


def cap_report(observations: DataFrame, most: int = 8) -> DataFrame:
    """(session_id, n, used) of the sessions that the cap cuts."""
    sizes = observations.where("session_id is not null").groupBy("session_id").agg(F.count("*").alias("n"))
    return sizes.where(F.col("n") > most).select("session_id", "n", F.lit(most).cast("long").alias("used"))


def duplicate_buckets(observations: DataFrame) -> DataFrame:
    """(type, text) groups of more than one row, with their first and last id and the newest summary."""
    normal = observations.withColumn("normalized", T.normalize_state(F.col("summary")))
    groups = normal.where("normalized <> ''").groupBy("type", "normalized").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max_by("summary", F.struct("updated_at", "id")).alias("latest_summary"))
    return groups.where("n > 1")


def priority_positions(observations: DataFrame, block: int = 50_000) -> DataFrame:
    """Oldest first, important rows ahead, ids compared as strings; ``pos`` within each project.

    A project is numbered over stretches of time of about ``block`` rows, so no project is sorted in one task: a
    row's place is that in its stretch after the rows of all earlier ones.
    """
    urgent = F.when(F.col("importance") >= 4, 0).otherwise(1)
    span = observations.groupBy("project_key").agg(F.min("updated_at").alias("first"), F.max("updated_at").alias("last"), F.count("*").alias("n"))
    width = F.greatest(F.ceil((F.col("last") - F.col("first") + 1) / F.ceil(F.col("n") / block)), F.lit(1)).alias("width")
    rows = observations.join(span.select("project_key", "first", width), "project_key").withColumn("urgent", urgent)
    rows = rows.withColumn("stretch", F.floor((F.col("updated_at") - F.col("first")) / F.col("width")))
    sizes = rows.groupBy("project_key", "urgent", "stretch").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("project_key").orderBy("urgent", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("project_key", "urgent", "stretch", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("project_key", "urgent", "stretch").orderBy("updated_at", F.col("id").cast("string")))
    placed = rows.withColumn("own", own).join(sizes, ["project_key", "urgent", "stretch"])
    return placed.withColumn("pos", (F.col("ahead") + F.col("own")).cast("int"))
