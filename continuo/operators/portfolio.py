"""Governance of all projects in one plan: rules, links and repairs are tables, and a row meets its project's rules.

A project's rules are one array, in order, beside its rows; people write them, so it is short. What they say of a row
is worked out inside the row: tag rules as a fold in which later rules see earlier tags, the others as tests of
any rule. Links are joined to the rows of their sources, each bounded before, and take the first that their selector
lets through. Nothing is collected, and no project is a call of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from continuo.operators import changes, governance, state
from continuo.operators.governance import as_inherited, policy_text
from continuo.plans.views import MEANINGFUL

_SELECTOR = "types array<string>, statuses array<string>, ids array<bigint>, text_contains array<string>, tags array<string>, `limit` int"
_RULE = f"selector struct<{_SELECTOR.replace(', `limit` int', '').replace(' array', ':array')}>, days bigint, tags array<string>"
#: Projects with rules or links up to which those are broadcast.
FEW = 100_000
NAMES = ("project_key", "item_key", "id", "session_id", "type", "title", "summary", "detail", "status", "updated_at", "tags", "inherited_from")


def rules(policies: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(project_key, rules): each project's own rules, oldest first, then those that links pass on.

    policies: project_key, n (their order), kind, rule (a normal form as JSON). links: project_key, n, source_key, mode.
    """
    read = F.from_json("rule", _RULE).alias("r")
    own = policies.select("project_key", F.lit(-1).cast("long").alias("link"), F.col("n").cast("long").alias("n"), "kind", read)
    if links is not None:
        passed = links.where(F.col("mode").isin(*governance.RULES_PASS)).select(F.col("project_key").alias("target"), F.col("source_key").alias("project_key"), F.col("n").cast("long").alias("place"))
        passed = own.join(passed, "project_key").select(F.col("target").alias("project_key"), F.col("place").alias("link"), "n", "kind", "r")
        own = own.unionByName(passed)
    each = F.struct("link", "n", "kind", "r.selector", "r.days", F.col("r.tags").alias("added"))
    return own.groupBy("project_key").agg(F.array_sort(F.collect_list(each)).alias("rules"))


def fits(chosen: Column, tags: Column) -> Column:
    """Whether an item (type, status, id, text) meets a selector beside some tags; no filter is met by everything."""
    free = lambda name: F.coalesce(F.size(chosen[name]), F.lit(0)) <= 0
    among = lambda name, column: free(name) | F.coalesce(F.array_contains(chosen[name], F.col(column)), F.lit(False))
    said = free("text_contains") | F.forall(chosen["text_contains"], lambda t: F.contains(F.col("text"), t))
    return among("types", "type") & among("statuses", "status") & among("ids", "id") & said & (free("tags") | F.arrays_overlap(tags, chosen["tags"]))


def _any(kind: str, now: int | None = None) -> Column:
    old = lambda r: F.lit(True) if now is None else F.coalesce(F.col("updated_at") <= now - r["days"] * 86_400, F.lit(False))
    return F.exists("rules", lambda r: (r["kind"] == kind) & fits(r["selector"], F.col("tags")) & old(r))


def effects(items: DataFrame, rules_of: DataFrame, now: int, repaired: DataFrame | None = None, few: bool = True) -> DataFrame:
    """What ``governance.effects`` adds, for the items of all projects. repaired: (project_key, id).

    few: the table of rules has been counted small, so it is broadcast.
    """
    rules_of = F.broadcast(rules_of) if few else rules_of
    out = items.join(rules_of, "project_key", "left").withColumn("rules", F.coalesce("rules", F.array().cast(rules_of.schema["rules"].dataType)))
    out = out.withColumns({"text": policy_text(), "tags": F.coalesce("tags", F.array().cast("array<string>"))})
    more = lambda tags, r: F.when((r["kind"] == "tag_as") & fits(r["selector"], tags), F.array_union(tags, r["added"])).otherwise(tags)
    out = out.withColumn("tags", F.aggregate("rules", F.col("tags"), more))
    out = out.withColumns({"never_archive": _any("never_archive"), "__old": _any("auto_archive_after", now), "__out": _any("exclude_from_pack"), "__keep": _any("always_keep_priority")})
    hidden = F.col("__old")
    if repaired is not None:
        gone = repaired.select("project_key", "id").distinct().withColumn("__repaired", F.lit(True))
        out = out.join(gone, ["project_key", "id"], "left")
        hidden = hidden | F.col("__repaired").isNotNull()
    archived = hidden & ~F.col("never_archive")
    out = out.withColumns({"retrieval_excluded": archived, "pack_excluded": archived | F.col("__out")})
    return out.withColumn("keep_priority", F.col("__keep") & ~F.col("pack_excluded")).drop("__old", "__out", "__keep", "__repaired", "text", "rules")


def inherited(items: DataFrame, links: DataFrame, passing: set[str], place: str, few: bool = True) -> DataFrame:
    """The rows that links bring into their projects, renamed. items: bounded rows of sources, with tags; where they
    have an ``age`` (1: the project's newest), only as many of the newest are looked at as the link takes.

    links: project_key, link_id, source_key, mode, selector (a normal form as JSON), n.
    """
    chosen = links.where(F.col("mode").isin(*passing)).select(
        F.col("project_key").alias("target"), F.col("link_id"), F.col("n").alias("link"), F.col("source_key").alias("project_key"), F.from_json("selector", _SELECTOR).alias("s")
    )
    # links have no filter on status or id
    rows = items.withColumn("text", policy_text()).join(F.broadcast(chosen) if few else chosen, "project_key")
    rows = rows.where(fits(F.col("s"), F.col("tags")))
    first = Window.partitionBy("target", "link_id").orderBy(F.desc("updated_at"), F.desc("id"))
    limit = F.coalesce(F.col("s.limit"), F.lit(governance.INHERITED_LIMIT))
    rows = rows.where(F.col("age") <= limit) if "age" in items.columns else rows
    rows = rows.withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") <= limit)
    rows = as_inherited(rows, F.col("project_key"), place)
    return rows.withColumn("project_key", F.col("target")).select(*NAMES, F.col("link_id"))


def numbered(versions: DataFrame, name: str) -> DataFrame:
    """The enabled rows of a versioned table in the order in which they count."""
    order = Window.partitionBy("project_key").orderBy("at", name)
    return versions.where("enabled").withColumn("n", F.row_number().over(order))


def visible(rows: DataFrame, hidden: str = "retrieval_excluded") -> DataFrame:
    """Rows that governance leaves, with ``pos``: own ones first, then inherited ones, each with priority ahead and the oldest first."""
    order = [F.col("inherited_from").isNotNull(), F.when(F.col("keep_priority"), 0).otherwise(1), "updated_at", F.coalesce(F.col("id").cast("string"), F.col("item_key"))]
    return rows.where(~F.col(hidden)).withColumn("pos", F.row_number().over(Window.partitionBy("project_key").orderBy(*order)))


def states(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state's items and its open ones of every project, from visible rows."""
    items = changes.state_items(rows.where(F.col("pos") <= changes.STATE_ROWS), "project_key")
    return items, state.open_work(items, "project_key")


def baselines(observations: DataFrame, syncs: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_key, since, source): the time that changes count from.

    The last sync before the latest meaningful change, else the one before the last, else the last, else none.
    """
    latest = observations.where(F.col("type").isin(*MEANINGFUL)).groupBy("project_key").agg(F.max("updated_at").alias("changed_at"))
    done = syncs.where("not skipped").select("project_key", "at").join(latest, "project_key", "left")
    last = Window.partitionBy("project_key").orderBy(F.desc("at"))
    before = done.groupBy("project_key").agg(F.max(F.when(F.col("at") < F.col("changed_at"), F.col("at"))).alias("before"))
    two = done.withColumn("k", F.row_number().over(last)).where("k <= 2")
    two = two.groupBy("project_key").agg(F.max(F.when(F.col("k") == 1, F.col("at"))).alias("last"), F.max(F.when(F.col("k") == 2, F.col("at"))).alias("previous"))
    ways = {"before": "sync_before_latest_meaningful_change", "previous": "previous_successful_context_sync", "last": "last_successful_context_sync"}
    named = reduce(lambda out, way: F.when(F.col(way).isNotNull(), ways[way]).otherwise(out), reversed(ways), F.lit("project_start"))
    out = projects.select("project_key").distinct().join(before, "project_key", "left").join(two, "project_key", "left")
    return out.select("project_key", F.coalesce("before", "previous", "last").alias("since"), named.alias("source"))
