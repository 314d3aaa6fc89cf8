"""Governance of all projects in one plan beside what the engine works out for one project at a time."""

from pyspark.sql import functions as F

from continuo.engine import Engine
from continuo.operators import portfolio
from continuo.plans.schemas import ENVELOPE

DAY = 86_400


def turn(project, number, time, messages, reply=None):
    return ("agent", project, f"s-{project}", str(number), None, time, messages, reply)


def test_all_projects_equal_each_one(spark, tmp_path):
    made = Engine(spark, str(tmp_path))
    base = [turn("base", k, f"1970-01-{k + 2:02}T00:00:00Z", [f"Constraint: keep part {k} local", f"Pending: mend gearbox {k}"], f"Decision: choose way {k}") for k in range(12)]
    other = [
        turn("target", 1, "1970-02-01T00:00:00Z", ["Objective: finish it; Pending: temporary scaffolding; Pending: old chore"], "Status: done"),
        turn("target", 2, "1970-02-20T00:00:00Z", ["Blocker: no access; Pending: newer chore"], "Decision: stay small"), turn("third", 1, "1970-02-01T00:00:00Z", ["Pending: alone"]),
    ]
    made.ingest(spark.createDataFrame([*base, *other], ENVELOPE))
    made.policy_add("base", "b1", "tag_as", {"selector": {"types": ["constraint"]}, "tag": "Inheritable"}, 1)
    made.policy_add("base", "b2", "tag_as", {"selector": {"tags": ["inheritable"], "text_contains": ["part 1"]}, "tag": "twice"}, 2)
    made.policy_add("base", "b3", "auto_archive_after", {"selector": {"text_contains": ["gearbox 3"]}, "days": 1}, 3)
    made.policy_add("base", "gone", "exclude_from_pack", {"selector": {"types": ["pending_item"]}}, 4)
    made.policy_remove("base", "gone", 4)
    made.policy_add("target", "t1", "exclude_from_pack", {"selector": {"text_contains": ["Temporary"]}}, 1)
    made.policy_add("target", "t2", "auto_archive_after", {"selector": {"types": ["pending_item"]}, "days": 10}, 2)
    made.policy_add("target", "t3", "never_archive", {"selector": {"text_contains": ["newer"]}}, 3)
    made.policy_add("target", "t4", "always_keep_priority", {"selector": {"text_contains": ["newer"]}}, 4)
    made.policy_add("target", "off", "exclude_from_pack", {"selector": {"types": ["blocker"]}}, 5, enabled=False)
    made.inheritance_add("target", "l1", "base", "marked_inheritable", 1, {"limit": 3})
    made.inheritance_add("target", "l2", "base", "combined", 2, {"types": ["decision", "pending_item"], "limit": 4})
    made.inheritance_add("third", "l3", "target", "rules_only", 3)
    made.inheritance_add("third", "l4", "base", "stable_decisions", 4)
    pending = made.observations("base").where("type = 'pending_item' and contains(detail, 'gearbox 5')").select("id", "project_key")
    made.store.append("repairs", pending.withColumns({"repair_kind": F.lit("archive"), "reason": F.lit("r"), "at": F.lit(9).cast("long")}))
    now = 70 * DAY
    found = made.portfolio(now)
    names = [c for c in portfolio.NAMES if c not in ("project_key", "session_id")] + ["retrieval_excluded", "pack_excluded", "keep_priority", "never_archive"]
    facts = lambda rows: sorted(repr(tuple(r)) for r in rows.select(*names).collect())
    items, left = (frame.cache() for frame in found.states())
    for project in ("base", "target", "third"):
        one, mine = made.effective(project, None, now), F.col("project_key") == project
        assert facts(found.rows.where(mine)) == facts(one.all_rows), project
        assert facts(found.decisions.where(mine)) == facts(one.all_decisions), project
        places = lambda rows: [r.item_key for r in rows.orderBy("pos").collect()]
        assert places(portfolio.visible(found.rows).where(mine)) == places(one.rows()), project
        want_items, want_left = one.state()
        state = lambda rows: sorted((r.type, r.pos, r.summary) for r in rows.collect())
        assert state(items.where(mine)) == state(want_items) and state(left.where(mine)) == state(want_left), project
    assert found.rows.where("project_key = 'target' and inherited_from = 'base'").count() >= 5
    assert found.decisions.where("project_key = 'third' and inherited_from = 'base'").count() == 8
    # baselines
    for at, skipped in ((10, False), (40 * DAY, False), (60 * DAY, False), (61 * DAY, True)):
        row = ("target", None, skipped, None, 1, 1, 1, 1, 1.0, "auto", None, 0.0, at)
        made.store.append("context_syncs", spark.createDataFrame([row], "project_key string, target_path string, skipped boolean, reason string, source_char_count long, pack_char_count long, source_tokens long, pack_tokens long, compression_ratio double, budget string, budget_reason string, build_ms double, at long"))
    got = {r.project_key: (r.since, r.source) for r in made.baselines().collect()}
    assert got == {p: made.baseline(p) for p in ("base", "target", "third")} and got["target"][1] == "sync_before_latest_meaningful_change"


def test_selectors_without_rules_meet_everything(spark):
    items = spark.createDataFrame([("p", None, None, None, None, None, None)], "project_key string, type string, status string, id long, title string, summary string, updated_at long").withColumn("tags", F.array().cast("array<string>"))
    rules = portfolio.rules(spark.createDataFrame([("p", 1, "exclude_from_pack", "{}")], "project_key string, n long, kind string, rule string"))
    assert portfolio.effects(items, rules, 0).first().pack_excluded
    none = portfolio.effects(items.withColumn("project_key", F.lit("q")), rules, 0).first()
    assert not none.pack_excluded and none.tags == []
