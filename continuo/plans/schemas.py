"""Schemas of the store's tables; every table is append-only and has the project's bucket as its partition."""

from __future__ import annotations

#: The envelope of one captured turn.
ENVELOPE = (
    "runtime string, project_key string, session_id string, turn_id string, cwd string, timestamp string, "
    "input_messages array<string>, assistant_message string"
)
#: Further fields that an envelope may have.
ENVELOPE_MORE = "tool_events string, artifacts string, metadata map<string,string>, raw_payload string"

#: Columns of the tables. Where a table has versions of a row, ``at`` orders them, then ``seq``, a
#: number of the project that every write of such rows raises; the newest counts.
TABLES = {
    "projects": "project_key string, root_path string, seen_at long",
    "sessions": "project_key string, runtime string, session_id string, cwd string, metadata map<string,string>, seen_at long, entry string",
    "turns": f"{ENVELOPE}, tool_events string, artifacts string, raw_payload string, content_hash string, captured_at long, model_name string, batch string",
    "observations": (
        "id long, project_key string, runtime string, session_id string, turn_id string, type string, title string, summary string, "
        "detail string, importance int, confidence double, status string, source_kind string, files array<string>, updated_at long, dedupe_hash string, batch string"
    ),
    "postings": "term string, id long, project_key string, title array<int>, summary array<int>, detail array<int>, dl int, batch string",
    "index_stats": "project_key string, rows long, words long, batch string",
    "removals": "project_key string, id long, batch string, at long",
    "batches": "project_key string, batch string, at long",
    "context_syncs": (
        "project_key string, target_path string, skipped boolean, reason string, source_char_count long, pack_char_count long, "
        "source_tokens long, pack_tokens long, compression_ratio double, budget string, budget_reason string, build_ms double, at long"
    ),
    "closure_events": (
        "project_key string, turn_id string, event_kind string, passed boolean, reasons array<string>, pending long, blockers long, "
        "dod_missing long, evidence long, claims long, at long, runtime string, session_id string"
    ),
    "provenance": (
        "memory_kind string, memory_id string, project_key string, runtime string, session_id string, turn_id string, observation_id long, "
        "turn_hash string, model_name string, cwd string, source_span string, at long, seq long"
    ),
    "snapshots": (
        "snapshot_id string, project_key string, label string, slug string, session_id string, text string, state string, snapshot_hash string, "
        "path string, created_at long, at long, seq long"
    ),
    "health_reports": (
        "report_id string, project_key string, score long, duplicate_count long, contradiction_count long, stale_item_count long, dod_total_count long, "
        "dod_missing_count long, dod_coverage_ratio double, open_work_count long, closure_mismatch boolean, details string, at long"
    ),
    "policies": "policy_id string, project_key string, kind string, rule string, enabled boolean, at long, deleted boolean, seq long",
    "inheritances": "link_id string, project_key string, source_key string, mode string, selector string, enabled boolean, at long, deleted boolean, seq long",
    "repairs": "project_key string, repair_kind string, id long, reason string, at long",
    "heartbeats": "process string, project_key string, profile string, read_only boolean, at long, deleted boolean",
}
#: Values of columns that older files of a table lack.
DEFAULTS = {"context_syncs": {"budget": "normal", "build_ms": 0.0}, "policies": {"enabled": True}, "inheritances": {"enabled": True}}


def columns(table: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(TABLES[table]).fieldNames()
