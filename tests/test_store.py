"""The store: replays after failures, order of versions, other writers, merges, closure after every turn."""

import json

import pytest
from pyspark.sql import functions as F

from continuo.engine import Engine
from continuo.kept import Kept
from continuo.operators import search
from continuo.plans.schemas import ENVELOPE, TABLES
from continuo.sources import store as stores
from continuo.sources.store import Store, bucket_of
from continuo.tools import Tools

SCHEMA = ENVELOPE + ", metadata map<string,string>"


def turn(project, number, time, messages, reply=None, session="s", model=None):
    return ("agent", project, session, str(number), "/w/x", time, messages, reply, {"model": model} if model else None)


def rows_of(store):
    """Everything in the store but the names of batches and numbers of versions."""
    out = {}
    for name in TABLES:
        if name == "index_stats":  # a row a project and batch
            out[name] = sorted(map(str, store.read(name).groupBy("project_key").agg(F.sum("rows"), F.sum("words")).collect()))
        elif name != "batches":
            kept = [c for c in store.read(name).columns if c not in ("batch", "seq")]
            out[name] = sorted(json.dumps(r.asDict(True), sort_keys=True) for r in store.read(name).select(*kept).collect())
    return out


class Broken(Exception):
    pass


def failing_at(monkeypatch, broken):
    """From now on what goes into one table fails."""
    append = Store.append

    def sometimes(self, table, rows, touched=None):
        if table == broken:
            raise Broken(table)
        append(self, table, rows, touched)

    monkeypatch.setattr(Store, "append", sometimes)


def test_a_replay_completes_every_table(spark, tmp_path, monkeypatch):
    rows = [
        turn("p", 1, "2026-01-01T00:00:00Z", ["Objective: ship it; Pending: write the docs"], "Decision: use Spark", model="m1"),
        turn("p", 2, "2026-01-02T00:00:00Z", ["Blocker: no access"], "Status: done"), turn("q", 1, "2026-01-01T00:00:00Z", ["Pending: other"]),
    ]
    events = spark.createDataFrame(rows, SCHEMA)
    clean = Engine(spark, str(tmp_path / "clean"))
    clean.ingest(events)
    want = rows_of(clean.store)
    assert want["closure_events"] and len(want["provenance"]) == len(want["observations"]) == clean.store.read("index_stats").agg(F.sum("rows")).first()[0]
    again = Engine(spark, str(tmp_path / "again"))
    for table in ("turns", "observations", "provenance", "postings", "index_stats", "projects", "sessions", "closure_events", "batches"):
        with monkeypatch.context() as patched, pytest.raises(Broken):
            failing_at(patched, table)
            again.ingest(events)
    again.ingest(events)
    assert rows_of(again.store) == want
    again.ingest(events)
    assert rows_of(again.store) == want
    # the first time that a batch comes it fails behind the observations; it comes again in a larger one
    other = Engine(spark, str(tmp_path / "other"))
    with monkeypatch.context() as patched, pytest.raises(Broken):
        failing_at(patched, "postings")
        other.ingest(spark.createDataFrame(rows[:1], SCHEMA))
    other.ingest(events)
    assert rows_of(other.store) == want
    # the first payload of a turn names its model
    other.ingest(spark.createDataFrame([turn("p", 1, "2026-01-01T00:00:00Z", ["Pending: not this"], model="m2")], SCHEMA))
    assert rows_of(other.store)["provenance"] == want["provenance"] and rows_of(other.store)["turns"] == want["turns"]


def test_versions_of_one_second_keep_their_order(spark, tmp_path):
    made = Engine(spark, str(tmp_path))
    rule = {"selector": {"types": ["blocker"]}}
    listed = lambda: [r.policy_id for r in made.policy_list("p").collect()]
    for _ in range(2):
        made.policy_add("p", "x", "exclude_from_pack", rule, 5)
        assert listed() == ["x"]
        assert made.policy_remove("p", "x", 5) and listed() == []
    made.policy_add("p", "x", "exclude_from_pack", rule, 5, enabled=False)
    assert [(r.enabled, r.seq) for r in made.policy_list("p").collect()] == [(False, 5)]
    made.inheritance_add("p", "l", "q", "combined", 5)
    assert made.inheritance_remove("p", "l", 5) and made.inheritance_list("p").count() == 0


def test_answers_see_other_writers_and_stay_few(spark, tmp_path):
    one, two = Engine(spark, str(tmp_path)), Engine(spark, str(tmp_path))
    tools = Tools(one, clock=lambda: 1000.0)
    one.ingest(spark.createDataFrame([turn("p", 1, "2026-01-01T00:00:00Z", ["Pending: first"]), turn("q", 1, "2026-01-01T00:00:00Z", ["Constraint: of q"])], SCHEMA))
    one.inheritance_add("p", "l", "q", "combined", 1)
    asked = lambda: tools.call("mem_open_work", {"project_key": "p"})["structuredContent"]["count"]
    assert one.open_work("p").count() == asked() == 1 and one.inherited("p").count() >= 1
    before = one.inherited("p").count()
    two.ingest(spark.createDataFrame([turn("p", 2, "2026-01-02T00:00:00Z", ["Blocker: second"])], SCHEMA))
    assert one.open_work("p").count() == asked() == 2
    two.ingest(spark.createDataFrame([turn("q", 2, "2026-01-02T00:00:00Z", ["Constraint: more of q"])], SCHEMA))
    assert one.inherited("p").count() > before  # the project it inherits from


def test_kept_answers_are_bounded():
    state, made = {"p": "1", "q": "1"}, []
    kept = Kept(state.__getitem__, 10)
    for now in range(10_000):
        kept.get(now, "p", lambda: made.append(1))
    assert len(kept) == 10 and len(made) == 10_000
    kept.get(9_999, "p", lambda: made.append(1), lambda _: ["q"])
    assert len(made) == 10_000  # it stands
    state["p"] = "2"
    kept.get(9_999, "p", lambda: made.append(1), lambda _: ["q"])
    state["q"] = "2"
    kept.get(9_999, "p", lambda: made.append(1), lambda _: ["q"])
    assert len(made) == 10_002


def plain_counts(rows):
    """(project, rows, words) of the index as if it was built now."""
    from continuo.sources.store import word_counts

    return sorted(tuple(r) for r in word_counts(rows).groupBy("project_key").agg(F.sum("rows"), F.sum("words")).collect())


def test_merges_bound_the_files_and_removals_leave_the_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "MOST_FILES", 3)
    made = Engine(spark, str(tmp_path))
    store, number = made.store, 5
    for k in range(number):
        made.ingest(spark.createDataFrame([turn("p", k, f"2026-01-0{k + 1}T00:00:00Z", [f"Pending: mend gearbox {k}"])], SCHEMA))
    parts = lambda table: list((tmp_path / table / f"bucket={bucket_of('p')}").glob("part-*"))
    assert all(len(parts(t)) <= 4 for t in ("postings", "observations", "turns", "provenance", "index_stats", "sessions"))
    assert store.read("turns").count() == number and not list(tmp_path.glob("_merged-*"))
    sums = lambda: sorted(tuple(r) for r in store.read("index_stats").groupBy("project_key").agg(F.sum("rows"), F.sum("words")).collect())
    assert sums() == plain_counts(store.read("observations"))
    found = lambda: {r.id for r in made.search("gearbox", "p", 50).collect()}
    gone = sorted(found())[:2]
    store.remove_observations("p", gone, 7)
    assert found().isdisjoint(gone) and store.read("observations").where(F.col("id").isin(gone)).count() == 0
    assert sums() == plain_counts(store.read("observations"))
    for table in ("postings", "observations", "index_stats"):
        store.merge(table, [bucket_of("p")])
    raw = spark.read.parquet(store.path("postings"))
    assert raw.where(F.col("id").isin(gone)).count() == 0 and sums() == plain_counts(store.read("observations"))
    terms = [r.term for r in spark.read.parquet(*map(str, parts("postings"))).select("term").collect()]
    assert terms == sorted(terms) and len(parts("postings")) == 1
    rebuilt = search.posting_rows(store.read("observations"), "batch")
    assert sorted(map(str, rebuilt.select(*raw.drop("bucket").columns).collect())) == sorted(map(str, raw.drop("bucket").collect()))
    # what was removed may come again
    made.note_create(spark.createDataFrame([("p", None, "gearbox note", "Note", None, 3)], "project_key string, session_id string, text string, title string, tags array<string>, importance int"), 8)
    note = store.read("observations").where("source_kind = 'manual_note'").first()
    store.remove_observations("p", [note.id], 9)
    made.note_create(spark.createDataFrame([("p", None, "gearbox note", "Note", None, 3)], "project_key string, session_id string, text string, title string, tags array<string>, importance int"), 8)
    assert store.read("observations").where(F.col("id") == note.id).count() == 1
    assert sums() == plain_counts(store.read("observations"))


def test_an_interrupted_merge_is_completed(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    for k in range(3):
        store.append("repairs", spark.createDataFrame([("p", "kind", k, "r", 1)], TABLES["repairs"]))
    with monkeypatch.context() as patched:
        patched.setattr(Store, "recover", lambda self: None)
        store.merge("repairs", [bucket_of("p")])
    (tmp_path / "_merged-half").mkdir()
    assert len(list(tmp_path.glob("_merged-*.json"))) == 1
    again = Store(spark, str(tmp_path))
    assert sorted(r.id for r in again.read("repairs").collect()) == [0, 1, 2] and not list(tmp_path.glob("_merged-*"))
    assert len(list((tmp_path / "repairs").glob("bucket=*/part-*"))) == 1


def test_a_claim_is_checked_after_every_turn(spark, tmp_path):
    texts = [
        (["Objective: ship it"], "ok"), (["Pending: write the docs"], "Status: done"), (["anything new?"], "not yet"), (["Completed: write the docs"], "Status: done"), (["Blocker: no access"], "hm"),
    ]
    rows = [turn("p", k, f"2026-01-0{k + 1}T00:00:00Z", *t) for k, t in enumerate(texts)] + [turn("q", 1, "2026-01-01T00:00:00Z", ["Pending: x"], "Status: done")]
    # one store a prefix: what a check of the whole project says once a turn is its newest
    want = []
    for k in (1, 3, 4):  # nothing is claimed before, and the third turn changes nothing
        one = Engine(spark, str(tmp_path / f"one{k}"))
        one.store.ingest(spark.createDataFrame(rows[: k + 1], SCHEMA))
        check = one.completion_check("p").first()
        if check.closure_mismatch:
            want.append((str(k), check.reasons.split(",")))
    assert [t for t, _ in want] == ["1", "4"]
    want.insert(1, ("2", want[0][1]))
    parts = Engine(spark, str(tmp_path / "parts"))
    for part in (rows[:2], rows[2:]):
        parts.ingest(spark.createDataFrame(part, SCHEMA))
    got = parts.store.read("closure_events").where("event_kind = 'mismatch'")
    assert sorted((r.turn_id, r.reasons) for r in got.where("project_key = 'p'").collect()) == want and got.where("project_key = 'q'").count() == 1
