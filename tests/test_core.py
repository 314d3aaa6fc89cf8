import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from continuo import registry
from continuo.functions import text as T
from continuo.operators import governance, notes, retrieval, state
from continuo.plans.schemas import ENVELOPE
from continuo.sources.notify import notify_to_envelope
from continuo.sources.store import Store
from continuo.streaming.ingest import ingest_stream


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    rows = [tuple(None if v is None or v is pd.NA or v != v else f"{float(v):.12g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in frame.itertuples(index=False)]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "events"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert plain(registry.QUERIES[name](spark, sf).toPandas()) == plain(con.sql(registry.ORACLES[name]).df())


def test_note_create_of_odd_texts_against_sql(spark, sf, tmp_path):
    odd = [None, None, "", " ", " \n\t ", "\x0b", "\xa0", "a\x0bb  c", "\x1ca\x85", "\xa0a\xa0\xa0b\u3000", "a \u2028", "x" * 79 + "\xa0yz", "x" * 79 + "\n\nyz", "a\x00", "a  b", "a b"]
    rows = [(k, text, ("p", None)[k % 3 == 0]) for k, text in enumerate(odd * 3)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for t in ("labels", "conversations", "events"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want, got = con.sql(registry.ORACLES["note_create"]).fetchall(), [tuple(r) for r in registry.QUERIES["note_create"](spark, str(tmp_path)).collect()]
    assert len(got) == 22 and sorted(got, key=repr) == sorted(want, key=repr)
    raw = spark.createDataFrame([("p", None, text, None, None, None) for text in odd[:10]], "project_key string, session_id long, text string, title string, tags array<string>, importance int")
    assert sorted(r.title for r in notes.create(raw).collect()) == ["Manual note: a", "Manual note: a b", "Manual note: a b c"]  # the operator refuses blank notes, as a tool does


def texts(spark, *pairs):
    return spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "id long, a string, b string")


def test_state_matching(spark):
    pairs = [("Docs still missing", "docs are missing"), ("no tests yet", "tests missing"), ("fix the parser", "write docs"), ("the release of the new build", "the release of the new build is late"), ("", "x")]
    a, b = T.normalize_state(F.col("a")), T.normalize_state(F.col("b"))
    got = [r[0] for r in texts(spark, *pairs).orderBy("id").select(T.state_matches(a, b)).collect()]
    assert got == [True, True, False, True, False]


def test_extract_labels(spark):
    text = "Objective: ship it. Later more\nPending: docs; Blocker: no access yet\nfine Done: parser\nStatus: done\nDecision: use Spark\nrule: and"
    rows = spark.createDataFrame([(1, text)], "id long, text string")
    got = {(r.kind, r.value) for r in state.extract(rows, "text", "id").collect()}
    assert got == {("objective", "ship it."), ("pending_item", "docs"), ("blocker", "no access yet"), ("completed_item", "parser"), ("completion_claim", "assistant claimed the work was complete")}


def test_fold_keeps_the_first_of_matching_texts(spark):
    rows = spark.createDataFrame([(1, 1, "docs missing"), (1, 2, "the docs missing"), (1, 3, "parser broken"), (1, 4, "tests red")], "g long, pos long, normalized string")
    assert sorted(r.pos for r in state.fold_dedupe(rows, "g", limit=2).collect()) == [1, 3]


def test_completion_and_budget(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0, 2, 1, 0, 0, 0), (2, 4, 0, 0, 0, 1, 0, 0, 0)], "g long, pending long, blockers long, dod_missing long, evidence long, claims long, constraints long, objectives long, summaries long")
    got = {r.g: (r.done, r.primary_reason, r.closure_mismatch, r.budget) for r in state.auto_budget(state.completion_check(rows)).collect()}
    assert got == {1: (True, "ready_to_close", False, "micro"), 2: (False, "pending_items_open", True, "normal")}


def test_search_falls_back_to_substrings(spark):
    rows = spark.createDataFrame([(1, 0, "a-b c", "", "", 5), (2, 0, "ab c", "", "", 6)], "id long, priority int, title string, summary string, detail string, updated_at long")
    assert [r.id for r in retrieval.search(rows, "a-b").collect()] == [1]
    assert [r.id for r in retrieval.search(rows, " ").collect()] == [2, 1]


def test_policy_validation():
    found = governance.validate("tag_as", {"selector": {"types": [" x ", 3], "tags": ["T"]}, "tag": "Y", "tags": "z", "note": " n "})
    assert found["valid"] and len(found["warnings"]) == 1 and found["normalized_rule"] == {"selector": {"types": ["x"], "statuses": [], "ids": [], "text_contains": [], "tags": ["t"]}, "apply_to": [], "tags": ["y", "z"], "note": "n"}
    assert governance.validate("nope", {})["errors"] and governance.validate("never_archive", {"selector": {"ids": ["4", "x"]}})["normalized_rule"]["selector"]["ids"] == [4]
    assert governance.validate_inheritance("marked_inheritable", {})["normalized_selector"] == {"types": [], "tags": ["inheritable"], "text_contains": [], "limit": 8}
    assert governance.validate_inheritance("rules_only", {"types": ["x"], "limit": -1}) | {"normalized_selector": 0} == {"valid": False, "errors": ["selector.limit must be a positive integer"], "warnings": ["rules_only ignores selector item filters"], "normalized_selector": 0}


def test_policy_texts_span_title_and_summary(spark):
    rows = spark.createDataFrame([(1, "blocker", "active", "Tail end", "Begins here", "hidden words", 5)], "id long, type string, status string, title string, summary string, detail string, updated_at long")
    hit = lambda text: governance.effects(rows, [("exclude_from_pack", {"selector": {"text_contains": [text]}})], 0).first().pack_excluded
    assert hit("tail") and hit("end begins") and hit("here begins") and not hit("hidden")


def test_notify_payloads(spark):
    base = '"type":"agent-turn-complete","thread-id":"t","turn-id":"1"'
    payloads = [
        "{%s,\"cwd\":\"/w/repo-x\",\"input-messages\":[\"a\",{\"text\":\"b\"},{\"content\":\"c\"},{\"z\":1,\"y\":2},null,7,\"\"],\"model\":\"m\"}" % base,
        '{%s,"input_messages":"one","project-name":" Named ","last-assistant-message":{"text":"said"}}' % base,
        '{%s,"input-messages":["see /srv/app/data-1/x.py, and C:\\\\Work\\\\tool-2."]}' % base,
        '{%s,"cwd":"C:\\\\Windows\\\\System32","workspace_key":"temp"}' % base, '{"type":"other"}', "no json",
    ]
    rows = spark.createDataFrame([(p,) for p in payloads], "value string")
    got = notify_to_envelope(rows).collect()
    assert [r.project_key for r in got] == ["default-project", "Named", "tool-2", "default-project"]
    assert got[0].input_messages == ["a", "b", "c", '{"y":2,"z":1}', "7"] and got[0].metadata["model_name"] == "m" and got[1].input_messages == ["one"] and got[1].assistant_message == "said"
    assert [r.project_key for r in notify_to_envelope(rows, project_from_cwd=True).collect()] == ["repo-x", "Named", "tool-2", "default-project"]
    assert {r.metadata["project_resolution_source"] for r in notify_to_envelope(rows, "mine").collect()} == {"explicit"}


def test_store_is_idempotent(spark, tmp_path):
    payload = '{"type":"agent-turn-complete","thread-id":"t","turn-id":"1","timestamp":"2026-01-01T00:00:00Z","input-messages":["Pending: docs"],"last-assistant-message":"Done: parser"}'
    events = notify_to_envelope(spark.createDataFrame([(payload,), ('{"type":"other"}',)], "value string"))
    store = Store(spark, str(tmp_path))
    for _ in range(2):
        store.ingest(events)
    assert spark.read.parquet(store.path("turns")).count() == 1
    assert sorted(r.type for r in spark.read.parquet(store.path("observations")).collect()) == ["completed_item", "pending_item", "session_summary", "user_request"]
    with pytest.raises(PermissionError):
        Store(spark, str(tmp_path), read_only=True).ingest(events)


def test_stream_ingest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"runtime":"codex","project_key":"p","session_id":"s","turn_id":"1","timestamp":"2026-01-01T00:00:00Z","input_messages":["Pending: docs"],"assistant_message":"ok"}\n' * 2)
    store = Store(spark, str(tmp_path / "store"))
    ingest_stream(spark, str(source), store, str(tmp_path / "ck")).awaitTermination(120)
    assert store.read("turns").count() == 1


def test_a_label_is_tried_once_on_a_segment(spark):
    """Kind, value and normal form of a fact are worked out one after the other, not each anew from the segment."""
    rows = spark.createDataFrame([(1, "Pending: ship it. Now or never; Done: no docs yet\nBlocker: x.\n\nstatus: done")], "k long, text string")
    found = state.extract(rows, "text", "k")
    assert found._jdf.queryExecution().analyzed().toString().count("pending|todo") <= 4
    assert sorted((r.kind, r.value, r.normalized) for r in found.collect()) == [
        ("blocker", "x.", "x"), ("completed_item", "no docs yet", "docs missing"), ("completion_claim", "assistant claimed the work was complete", "status done"), ("pending_item", "ship it.", "ship it"),
    ]


def test_normal_form_of_states_in_one_pass(spark):
    def plain(text):  # the rule, step by step
        text = T.squash(F.lower(T.squash(F.coalesce(text, F.lit("")))))
        text = F.regexp_replace(F.regexp_replace(text, T.STILL_MISSING, " missing"), T.NOT_YET, "$1 missing")
        return T.squash(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " "))

    texts = [None, "", " ", " .a", "a. ", "a  b", "a\t- b", "No docs\nyet!", "no Yet", "is STILL  missing: x", "distill missing", "yeti no a yet, no b yeti yet.", "É-ß_1́²", "Σ ΟΔΟΣ\nΟΔΟΣ.", "a\x85b\x1cc\x00d", "　x﻿ y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.normalize_state(F.col("t")).alias("got"), plain(F.col("t")).alias("want"))
    assert all(r.got == r.want for r in rows.collect())
    start = time.monotonic()
    long = spark.createDataFrame([("no words " * 60_000,)], "t string").select(F.length(T.normalize_state(F.col("t"))).alias("n"))
    assert long.first().n == 60_000 * 9 - 1 and time.monotonic() - start < 10  # each "no" had searched the rest for "yet"
