"""The tools over one store, end to end."""

import json

import pytest
from pyspark.sql import functions as F

from continuo.engine import BLOCK_END, BLOCK_START, Engine, managed_block
from continuo.operators import pack
from continuo.plans.schemas import ENVELOPE, TABLES
from continuo.sources.store import bucket, bucket_of
from continuo.sources.telemetry import Telemetry
from continuo.tools import TOOLS, Tools

NOTE = "project_key string, session_id string, text string, title string, tags array<string>, importance int"
DAY = 86_400
LONG = "We looked at the parser and its tests for a long while. " * 30


def events(spark, rows):
    return spark.createDataFrame(rows, ENVELOPE)


def turn(project, session, number, time, messages, reply=None, cwd=None, runtime="agent"):
    return (runtime, project, session, str(number), cwd, time, messages, reply)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    made = Engine(spark, str(tmp_path_factory.mktemp("store")))
    rows = [
        turn("demo", "s1", 1, "1970-01-02T00:00:00Z", ["Objective: ship the parser; Pending: write the docs", "Blocker: no access yet"], LONG, "/w/repo-a"),
        turn("demo", "s1", 2, "1970-03-01T00:00:00Z", ["Project DoD: tests are green"], "Decision: use Spark\nDone: docs write\n" + LONG),
        turn("demo", "s2", 1, "1970-03-02T00:00:00Z", ["Blocker: access still missing"], "Status: done\n" + LONG, "/w/repo-b/"),
        turn("other", "s3", 1, None, None),
        turn("other", "s1", 1, "1970-03-02T00:00:00Z", ["Pending: a turn of equal session and number"]),
        turn("demo", "s1", 1, "1970-03-02T00:00:00Z", ["Pending: the same of another runtime"], runtime="shell"),
    ]
    for _ in range(2):  # replays change nothing
        made.ingest(events(spark, rows))
    return made


def test_turns_of_projects_and_runtimes_stay_apart(engine):
    keys = {(r.project_key, r.runtime, r.session_id, r.turn_id) for r in engine.store.read("turns").collect()}
    assert len(keys) == engine.store.read("turns").count() == 6
    assert [r.summary for r in engine.open_work("other").collect()] == ["a turn of equal session and number"]
    assert {r.session_id for r in engine.session_list("other").collect()} == {"s1", "s3"}
    hashes = engine.provenance("demo").where("memory_kind = 'observation'")
    assert hashes.where("turn_hash is null or turn_hash <> content_hash").count() == 0 and hashes.count() == engine.observations("demo").count()


def test_state_reports(engine):
    want = {("blocker", "no access yet"), ("project_dod", "tests are green"), ("pending_item", "the same of another runtime")}
    assert {(r.type, r.summary) for r in engine.open_work("demo").collect()} == want  # the oldest of matching blockers stays
    check = engine.completion_check("demo", record=True, now=7).first()
    assert (check.reasons, check.primary_reason, check.closure_mismatch) == ("pending_items_open,blockers_open,dod_incomplete", "pending_items_open", True)
    guard = engine.scope_guard("demo").first()
    assert guard.flags == ["closure_mismatch", "pending_work_open", "blockers_open", "dod_incomplete"] and guard.must_not_drop[0] == "ship the parser"
    assert guard.broad_scope_detected and guard.source_session_count == 3
    metrics = engine.closure_metrics("demo").first()
    assert (metrics.mismatches, metrics.failed) == (2, 3) and metrics.reason_counts["blockers_open"] == 3  # after the claim's turn and the next one; one asked for
    empty = engine.completion_check("nobody").first()
    assert (empty.reasons, empty.done) == ("missing_evidence", False)
    states = {r.summary: r.open for r in engine.operational_state("demo").collect()}
    assert states["write the docs"] is False and states["no access yet"] is True


def test_session_scope(engine):
    assert {r.summary for r in engine.open_work("demo", "s2").collect()} == {"access still missing"}
    assert {r.session_id for r in engine.recent("demo", 50, "s2").collect()} == {"s2"}
    assert {r.session_id for r in engine.search("parser", "demo", 50, "s1").collect()} == {"s1"}
    made = engine.context_pack("demo", budget="full", session_id="s2")
    assert "session_filter=applied; source_sessions=1; external_session_id=s2" in made["text"] and "ship the parser" not in made["text"]
    assert made["scope_warning"] is None and made["source_sessions"] == ["s2"]
    for ask in (lambda: engine.open_work("demo", "s3"), lambda: engine.context_pack("other", session_id="s2")):
        with pytest.raises(ValueError, match="Session not found"):
            ask()
    whole = engine.context_pack("demo", budget="full")
    assert "Scope warning:" in whole["text"] and "No active objective selected" in whole["text"] and "### Objective" not in whole["text"]
    small = engine.context_pack("demo", max_chars=600, budget="full")
    assert "Suggested narrowing" not in small["text"] and "Instructions override advisory memory." in small["text"]


def test_changes_since_a_baseline(spark, tmp_path):
    made = Engine(spark, str(tmp_path))
    first = turn("p", "t", 1, "2026-04-17T00:00:00Z", ["Objective: preserve scope.\nProject DoD: keep closure deterministic.\nConstraint: keep it closed.\nPending: expose open work.\nBlocker: no human validation yet."], "Decision: keep it local.\n" + LONG)
    made.ingest(events(spark, [first]))
    assert made.baseline("p") == (None, "project_start")
    start = 1_776_384_000
    made.sync_document("p", "# Guide", start + 60)
    assert made.baseline("p") == (start + 60, "last_successful_context_sync")
    second = turn("p", "t", 2, "2026-04-17T00:10:00Z", ["Completed: expose open work.\nPending: refresh the install.\nObjective: preserve scope."], "Decision: add a guard.")
    made.ingest(events(spark, [second]))
    found = {(r.part, r.change, r.summary) for r in made.recent_changes("p").collect()}
    assert found == {("pending", "removed", "expose open work."), ("pending", "added", "refresh the install."), ("decision", "added", "add a guard.")}
    assert made.recent_changes("p").first().baseline_source == "sync_before_latest_meaningful_change"
    everything = {(r.part, r.change) for r in made.recent_changes("p", since=1).collect()}
    assert ("objective", "changed") in everything and ("constraint", "added") in everything and ("dod", "added") in everything


def test_pack_document_and_hash(engine, tmp_path):
    made = engine.context_pack("demo", budget="full")
    assert made["pack_tokens"] < made["source_tokens"] and "- use Spark" in made["text"] and made["sessions_capped"] == [{"session": "s1", "n": 10, "used": 8}]
    engine._kept.clear()  # worked out again, it is the same
    assert engine.context_pack("demo", budget="full", known_hash=made["pack_hash"]) == {"not_modified": True, "pack_hash": made["pack_hash"], "message": "continuity pack unchanged"}
    assert len(engine.context_pack("demo", budget="micro")["text"]) <= len(made["text"])
    document = engine.sync_document("demo", "# Guide", 1)
    assert document.startswith("# Guide\n\n" + BLOCK_START) and managed_block(document, "new").count(BLOCK_END) == 1
    assert engine.sync_document("nobody", "same", 2) == "same"
    assert engine.context_metrics("demo").first().synced >= 1 and engine.store.read("provenance").where("memory_kind = 'context_sync'").count() >= 1
    (tmp_path / "AGENTS.override.md").write_text("mine")
    assert engine.sync_folder("demo", str(tmp_path), 4).endswith("/AGENTS.override.md") and (tmp_path / "AGENTS.override.md").read_text().startswith("mine\n\n" + BLOCK_START)


def test_notes_and_search(engine, spark):
    raw = spark.createDataFrame([("demo", None, "do not publish before the release hold ends", "Release hold", ["freeze"], 5), ("demo", None, "release hold of no importance", "Release hold too", ["test"], 1), ("demo", "s1", "a note of a session", None, None, 2)], NOTE)
    for _ in range(2):
        engine.note_create(raw, 100)
    assert engine.observations("demo").where("source_kind = 'manual_note'").count() == 3
    found = engine.search("release hold", "demo").collect()
    assert found[0].title == "Release hold" and found[0].score > 100 and [r.score for r in found[1:]] == [0.0] * len(found[1:])
    assert not [r for r in found if r.title == "Release hold too"]  # found, but its meta tag keeps its score at nothing
    assert engine.search("parser NOT parser", "demo").count() == 0 and engine.search('title : "release hold"', "demo").count() >= 1
    with pytest.raises(ValueError):
        engine.note_create(spark.createDataFrame([("demo", "s3", "x", None, None, 1)], NOTE), 1)
    assert engine.store.read("postings", "demo").where("term = 'parser'").count() > 0


def test_search_filters_before_the_limit(spark, tmp_path):
    made = Engine(spark, str(tmp_path))
    hot = [turn("hot", "h", k, "1970-03-01T00:00:00Z", [f"Pending: mend gearbox {k}"]) for k in range(260)]
    made.ingest(events(spark, [*hot, turn("small", "s", 1, "1970-01-02T00:00:00Z", ["Pending: mend the gearbox of the very old red tractor"]), turn("small", "s", 2, "1970-01-03T00:00:00Z", [r"look into C:\repo\x"])]))
    want = {r.id for r in made.observations("small").collect() if "gearbox" in r.detail + r.summary}
    assert {r.id for r in made.search("gearbox", "small").collect()} == want and len(want) == 3
    assert {r.id for r in made.search("GEAR% of", "small").collect()} >= want - {0} and made.search("mend-gearbox", "small").count() == 0
    assert made.search("gearbox", limit=50).count() == 50
    assert {r.type for r in made.search(r"c:\REPO", "small").collect()} == {"user_request", "session_summary"}
    # the index ranks as the texts do
    from continuo.operators import retrieval, search

    rows = made.observations()
    for query in ("gearbox tractor", '"old red"', "mend OR look", "gear* NOT tractor", "summary : mend"):
        tree, phrases = search.parse(query)
        sums = made.store.read("index_stats").agg(F.sum("rows").alias("n"), (F.sum("words") / F.sum("rows")).alias("avg_dl"))
        by_index = {r.id: r.rank for r in search.ranked(search.counts_in_postings(made.store.read("postings"), phrases), tree, sums).collect()}
        by_text = {r.id: r.rank for r in retrieval.bm25(rows, query).collect()}
        assert by_index.keys() == by_text.keys() and by_text and all(abs(by_index[k] - by_text[k]) < 1e-9 for k in by_text)
    made.policy_add("small", "x", "auto_archive_after", {"selector": {"text_contains": ["tractor"]}, "days": 1}, 1)
    assert made.search("tractor", "small", now=DAY * 9).count() == 0 < made.search("tractor", "small", now=DAY).count()


def test_search_shows_copies_once(spark, tmp_path):
    made = Engine(spark, str(tmp_path))
    same = [turn("p", f"s{k % 4}", k, f"2026-01-0{k % 9 + 1}T00:00:00Z", ["Pending: oil the old gate"]) for k in range(12)]
    made.ingest(events(spark, [*same, turn("p", "s9", 1, "2026-02-01T00:00:00Z", ["Blocker: oil the old gate"])]))
    found = {r.type: r for r in made.search("gate", "p", 50).where("type in ('pending_item', 'blocker')").collect()}
    assert (found["pending_item"].duplicate_count, found["pending_item"].session_ids) == (12, ["s0", "s1", "s2", "s3"])
    assert found["blocker"].duplicate_count == 1  # of another type


def test_captures_outside_the_root_are_left_out(spark, tmp_path):
    made = Engine(spark, str(tmp_path))
    schema = ENVELOPE + ", metadata map<string,string>"
    rows = [
        ("agent", "p", "in", "1", "/w/repo/sub", "2026-01-01T00:00:00Z", ["Pending: mend it inside"], None, {"project_root_path": "/w/repo", "producer_version": "1", "capture_schema_version": "2"}),
        ("agent", "p", "out", "1", "/elsewhere", "2026-01-02T00:00:00Z", ["Pending: mend it outside"], None, {"project_root_path": "/w/repo", "project_resolution_source": "mentioned_path:leaf"}),
        ("agent", "p", "in", "2", None, "2026-01-03T00:00:00Z", ["Pending: mend it later"], None, {"producer_version": "2", "capture_schema_version": "1", "model": " "}),
    ]
    made.ingest(spark.createDataFrame(rows, schema))
    assert {r.session_id for r in made.recent("p", 50).collect()} == {"in"} == {r.session_id for r in made.search("mend", "p", 50).collect()}
    assert {r.session_id for r in made.recent("p", 50, "out").collect()} == {"out"}  # unless asked for
    assert "outside" not in made.context_pack("p")["text"] and {r.turn_id for r in made.recent_turns("p").collect()} == {"1", "2"}
    one = {r.session_id: r for r in made.store.sessions("p").collect()}
    assert one["out"].warning == "mentioned_path_capture_cwd_outside_project_root" and one["in"].cwd == "/w/repo/sub"
    assert one["in"].metadata == {"project_root_path": "/w/repo", "producer_version": "2", "producer_version_first_seen": "1", "capture_schema_version": "2"}


def test_policies_and_inheritance(spark, tmp_path):
    made = Engine(spark, str(tmp_path))
    base = turn("base", "b", 1, "2026-04-18T00:00:00Z", ["Objective: stabilize shared auth.\nConstraint: keep it local-first.\nConstraint: secret token ABC-123 must stay internal.\nPending: preserve auth lineage."], "Decision: keep auth shared across projects.\nDecision: Secret token ABC-123 should never enter packs.")
    target = turn("target", "t", 1, "2026-04-18T00:05:00Z", ["Objective: finish target continuity.\nPending: temporary scaffolding cleanup.\nPending: expose final dashboard."], "Decision: keep project focused.")
    made.ingest(events(spark, [base, target]))
    made.policy_add("base", "b1", "tag_as", {"selector": {"types": ["constraint"]}, "tag": "Inheritable"}, 1)
    made.policy_add("target", "t1", "exclude_from_pack", {"selector": {"text_contains": ["Temporary scaffolding"]}}, 1)
    made.policy_add("target", "t2", "exclude_from_pack", {"selector": {"text_contains": ["ABC-123"]}}, 2)
    made.inheritance_add("target", "l1", "base", "combined", 3, {"limit": 4})
    text = made.context_pack("target", budget="full")["text"]
    assert "temporary scaffolding cleanup" not in text and "ABC-123" not in text
    assert "keep auth shared across projects" in text and "keep it local-first" in text and "### Selection rules" in text
    assert {r.item_key.split(":")[0] for r in made.inherited("target").collect()} == {"inh-observation", "inh-decision"}
    brief = made.project_brief("target")
    assert any("inherited from base" in d["decision_text"] for d in brief["recent_decisions"]) and brief["inheritances"] and brief["counts"]["turns"] == 1
    made.inheritance_remove("target", "l1", 4)
    made.inheritance_add("target", "l2", "base", "marked_inheritable", 5)
    assert {r.type for r in made.inherited("target").collect()} == {"constraint"}
    assert made.inheritance_remove("target", "l2", 6) and not made.inheritance_remove("target", "l2", 7)
    for bad in (("nope", {}), ("exclude_from_pack", {}), ("tag_as", {"selector": {"types": ["x"]}}), ("auto_archive_after", {"selector": {"types": ["x"]}, "days": 0})):
        with pytest.raises(ValueError):
            made.policy_add("target", "bad", *bad, 1)
    with pytest.raises(ValueError):
        made.inheritance_add("target", "bad", "base", "nope", 1)


def test_policies_count_before_limits_and_never_archive(spark, tmp_path):
    made = Engine(spark, str(tmp_path))
    things = ["paint fences", "sweep chimneys", "mend gearbox", "water lemons", "count sheep", "bake bread", "tune pianos", "sell tickets"]
    made.ingest(events(spark, [turn("p", "s", k, f"1970-03-0{k + 1}T00:00:00Z", [f"Pending: {x}"], LONG) for k, x in enumerate(things)]))
    for k, x in enumerate(things[:6]):  # the oldest six, which would fill the state
        made.policy_add("p", f"x{k}", "auto_archive_after", {"selector": {"types": ["pending_item"], "text_contains": [x]}, "days": 1}, k)
    made.policy_add("p", "keep", "never_archive", {"selector": {"text_contains": [things[0]]}}, 9)
    made.policy_add("p", "first", "always_keep_priority", {"selector": {"text_contains": [things[7]]}}, 10)
    kept = [r.summary for r in made.open_work("p", now=10**9).orderBy("pos").collect()]
    assert kept == [things[7], things[0], things[6]]
    assert made.policy_remove("p", "first", 11) and [r.summary for r in made.open_work("p", now=10**9).orderBy("pos").collect()] == [things[0], things[6], things[7]]


def test_health_repairs_and_reviews(spark, tmp_path):
    made = Engine(spark, str(tmp_path))
    said = "Objective: close review.\nPending: verify final evidence.\nProject DoD: all green"
    made.ingest(events(spark, [turn("p", "s", 1, "2026-02-10T00:00:00Z", [said]), turn("p", "s", 2, "2026-02-11T00:00:00Z", ["Pending: verify final evidence."], "Status: done")]))
    now = 1_780_000_000
    report = made.health("p", now, record=True)
    assert report["duplicate_count"] >= 1 and report["stale_item_count"] == 2 and report["closure_mismatch"] and report["dod_coverage_ratio"] == 0.0
    assert report["score"] == 100 - 4 - 15 - 6 - 8 and [c["kind"] for c in report["contradictions"]] == ["closure_mismatch"]
    assert made.store.read("health_reports", "p").first().score == report["score"] and made.store.read("provenance", "p").where("memory_kind = 'health_report'").count() == 1
    kinds = {r.repair_kind for r in made.repair_propose("p", now).collect()}
    assert kinds == {"archive_duplicate_observations", "archive_stale_open_items", "review_contradictions", "review_dod_gaps"}
    before = made.recent("p", 50).count()
    assert made.repair_apply("p", "archive_duplicate_observations", now) == 1
    assert made.recent("p", 50).count() == before - 1 and made.health("p", now)["duplicate_count"] == 0
    with pytest.raises(ValueError):
        made.repair_apply("p", "review_contradictions", now)


def test_snapshots(engine):
    one = engine.snapshot_create("demo", "Before: release", 5)
    assert one["slug"] == "before-release" and one["path"].endswith(f"__before-release__{one['snapshot_hash'][:12]}.json") and one["provenance_confidence"] == "low"
    assert engine.snapshot_create("demo", "x", 6, "s1")["provenance_confidence"] == "high"
    kept = json.loads(engine.store.latest("snapshots", ("snapshot_id",), "demo").where(F.col("snapshot_id") == one["snapshot_id"]).first().state)
    assert {"operational_state", "open_work", "health", "context_pack", "recent_changes", "closure_metrics"} <= set(kept)
    back = engine.snapshot_restore("demo", one["snapshot_id"], 9, "doc")
    assert back["context_pack"]["text"] == one["text"] and back["document"].startswith("doc\n\n" + BLOCK_START)
    assert engine.snapshot_list("demo").where(F.col("snapshot_id") == one["snapshot_id"]).first().at == 9
    with pytest.raises(ValueError):
        engine.snapshot_restore("demo", "none", 9)


def test_routing(engine):
    found = engine.scope_routing("demo", "repo-b", "/x/repo-b")
    assert found["routing_decision"] == "lane_resolved" and found["candidates"][0]["session_id"] == "s2" and found["do_not_fetch_project_wide_pack"]
    assert engine.scope_routing("demo", "nothing of the kind")["routing_decision"] == "no_match" and engine.scope_routing("demo")["routing_decision"] == "needs_hint"
    assert engine.bootstrap_context("demo", "repo-b", "/x/repo-b")["selection_mode"] == "lane_needs_session_selection"
    assert engine.bootstrap_context("demo")["selection_mode"] == "needs_narrowing"
    named = engine.bootstrap_context("demo", session_id="s2")
    assert named["selection_mode"] == "explicit_session_id" and named["context_pack"]["session_id"] == "s2"
    assert [r.session_id for r in engine.session_list(query="repo-a").collect()] == ["s1"]
    assert {(r.turn_id, r.observations > 0) for r in engine.turn_list("demo", "s1").collect()} == {("1", True), ("2", True)}


def test_tools_profiles_cache_and_modes(spark, tmp_path):
    store = str(tmp_path / "store")
    made, time = Engine(spark, store), [1000.0]
    made.ingest(events(spark, [turn("p", "s", 1, "2026-01-01T00:00:00Z", ["Pending: docs"], LONG)]))
    log = Telemetry("summary", str(tmp_path / "log"), clock=lambda: time[0])
    tools = Tools(made, clock=lambda: time[0], telemetry=log)
    assert len(TOOLS) == len(set(TOOLS)) == 28 and set(Tools(made, "minimal").list()) < set(Tools(made, "standard").list()) < set(tools.list())
    first = tools.call("mem_open_work", {"project_key": "p"})
    assert first["structuredContent"]["count"] == 1 and not first["isError"]
    tools.call("mem_open_work", {"project_key": "p"})
    assert (tools.hits, tools.misses) == (1, 1)
    time[0] += 16
    tools.call("mem_open_work", {"project_key": "p"})
    assert (tools.hits, tools.misses) == (1, 2)
    tools.call("mem_note_create", {"project_key": "p", "text": "a note", "tags": "one"})
    tools.call("mem_open_work", {"project_key": "p"})
    assert (tools.hits, tools.misses) == (1, 3)  # another revision
    for name, arguments in {
        "mem_search": {"query": "docs", "project_key": "p"}, "mem_recent": {"project_key": "p", "limit": 3}, "mem_session_list": {"project_key": "p"}, "mem_scope_resolve": {"project_key": "p"}, "mem_completion_check": {"project_key": "p"},
        "mem_recent_changes": {"project_key": "p"}, "mem_scope_guard": {"project_key": "p"}, "mem_context_pack": {"project_key": "p"}, "mem_health": {"project_key": "p"}, "mem_health_runtime": {}, "mem_bootstrap_context": {"project_key": "p"},
        "mem_policy_validate": {"policy_kind": "tag_as", "rule": {"tag": "x"}}, "mem_policy_add": {"project_key": "p", "policy_kind": "tag_as", "rule": {"tag": "x"}}, "mem_policy_list": {"project_key": "p"}, "mem_repair_propose": {"project_key": "p"}, "mem_snapshot_list": {"project_key": "p"},
    }.items():
        answer = tools.call(name, arguments)
        assert not answer["isError"], (name, answer)
    assert tools.call("mem_open_work", {"project_key": "nobody"})["structuredContent"] == {"error": "Project not found"}
    assert Tools(made, "minimal").call("mem_search", {})["isError"] and "Tool unavailable" in Tools(made, "minimal").call("mem_search", {})["content"][0]["text"]
    frozen = Tools(Engine(spark, store, read_only=True), mode="verbose")
    assert frozen.call("mem_policy_add", {"project_key": "p"})["isError"] and json.loads(frozen.call("mem_open_work", {"project_key": "p"})["content"][0]["text"])
    assert len((tmp_path / "log" / "events.jsonl").read_text().splitlines()) > 20
    for k in range(5):
        made.beat(f"pid{k}", "full", 900 + k)
    assert made.health_runtime(1000) == {"same_store_process_count": 5, "spawn_storm_warning": True} and made.health_runtime(1022)["same_store_process_count"] == 3


def test_one_project_reads_one_bucket(engine, spark):
    for key in ("demo", "other", "", "Ünï"):
        assert spark.range(1).select(bucket(F.lit(key))).first()[0] == bucket_of(key)
    plan = engine.store.read("observations", "demo")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and f"= {bucket_of('demo')})" in plan
    engine.store.views()
    assert {t.name for t in spark.catalog.listTables()} >= set(TABLES)


def plain_pack(header, sections, max_chars):
    """The budget fold written out over lines."""
    lines, titles = list(header), []
    for title, candidates, fallback, unless_long in sections:
        if unless_long and candidates and len("\n".join(lines).strip()) >= max_chars * 0.55:
            continue
        own = [f"### {title}"]
        for c in candidates:
            if len("\n".join([*lines, *own, c, ""]).strip()) > max_chars:
                break
            own.append(c)
        if len(own) == 1 and fallback and len("\n".join([*lines, *own, fallback, ""]).strip()) <= max_chars:
            own.append(fallback)
        if len(own) > 1:
            lines += [*own, ""]
            titles.append(title)
    return "\n".join(lines).strip(), titles


def test_fold_of_sections_against_plain_python(spark):
    import random

    r, rows, want = random.Random(6), [], {}
    for k in range(60):
        header = ["## Top", "", "x" * r.randrange(30), ""]
        sections = [(f"S{i}", ["- " + "word " * r.randrange(1, 12) + "." for _ in range(r.randrange(4))], r.choice([None, "- none yet"]), r.random() < 0.3) for i in range(6)]
        most = r.randrange(20, 700)
        rows.append((k, "\n".join(header), sections, most))
        want[k] = plain_pack(header, sections, most)
    table = spark.createDataFrame(rows, "k int, header string, sections array<struct<title:string,lines:array<string>,fallback:string,unless_long:boolean>>, most int")
    done = table.select("k", pack.fold_sections(F.col("header"), F.col("sections"), F.col("most")).alias("d")).collect()
    assert {x.k: (x.d.text.strip(), x.d.titles) for x in done} == want
