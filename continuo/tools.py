"""The engine's methods as named tools: profiles, read-only gate, response modes, and answers kept for a while."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from continuo.engine import Engine
from continuo.kept import Kept
from continuo.sources.telemetry import Telemetry, stable_hash

#: Tools, those that write, those of the smallest profile, those whose answers are kept, and argument bounds.
TOOLS = (
    "mem_search", "mem_get", "mem_recent", "mem_note_create", "mem_session_list", "mem_scope_resolve", "mem_bootstrap_context", "mem_project_brief", "mem_open_work",
    "mem_completion_check", "mem_recent_changes", "mem_scope_guard", "mem_context_pack", "mem_provenance", "mem_health", "mem_health_runtime", "mem_snapshot_list", "mem_snapshot_create",
    "mem_snapshot_restore", "mem_policy_list", "mem_policy_validate", "mem_policy_add", "mem_policy_remove", "mem_inheritance_list", "mem_inheritance_add", "mem_inheritance_remove",
    "mem_repair_propose", "mem_repair_apply",
)
WRITES = ("mem_note_create", "mem_snapshot_create", "mem_snapshot_restore", "mem_policy_add", "mem_policy_remove", "mem_inheritance_add", "mem_inheritance_remove", "mem_repair_apply")
MINIMAL = ("mem_session_list", "mem_scope_resolve", "mem_bootstrap_context", "mem_open_work", "mem_completion_check", "mem_context_pack", "mem_health_runtime")
PROFILES = {"minimal": MINIMAL, "standard": tuple(t for t in TOOLS if t not in WRITES), "full": TOOLS}
KEPT = ("mem_context_pack", "mem_project_brief", "mem_open_work", "mem_scope_guard")
KEEP_SECONDS, MOST_ROWS = 15, 1000
#: Answers that are kept at most; one stands for KEEP_SECONDS, and no longer than the project's rows.
MOST_KEPT = 256
_NOTE = "project_key string, session_id string, text string, title string, tags array<string>, importance int"


def summary(data, failed: bool = False) -> str:
    """One line about an answer."""
    if failed:
        return f"error: {data['error']}"
    if isinstance(data, list):
        return f"result list items={len(data)}"
    if data.get("not_modified"):
        return f"continuity pack unchanged ({data['pack_hash']})"
    if "selection_mode" in data:
        found = data["scope_resolution"] or {}
        return f"bootstrap_context selection_mode={data['selection_mode']} context_pack_present={bool(data['context_pack'])} routing={found.get('routing_decision', 'unknown')} candidate_lanes={len(found.get('candidate_lanes') or [])}"
    if "routing_decision" in data:
        return f"scope_resolve routing={data['routing_decision']} confidence={data['confidence']} candidate_lanes={len(data['candidate_lanes'])} do_not_fetch_project_wide_pack={data['do_not_fetch_project_wide_pack']}"
    if "pack_hash" in data and "text" in data:
        lines = [f"context_pack budget={data['budget']} pack_tokens={data['pack_tokens']} source_tokens={data['source_tokens']} ratio={data['compression_ratio']} hash={data['pack_hash']}"]
        mode = "applied" if data["session_filter_applied"] else "not_applied"
        warning = f" scope_warning={data['scope_warning']}" if data["scope_warning"] else ""
        return "\n".join([*lines, f"session_filter={mode} source_sessions={data['source_session_count']}{warning}"])
    if "score" in data:
        return f"health score={data['score']} open_work={data['open_work_count']}"
    return f"result object keys={len(data)}"


class Tools:
    """Calls tools by name. ``clock`` gives seconds; answers of some tools are kept as long as the project's revision."""

    def __init__(self, engine: Engine, profile: str = "full", mode: str = "compact", clock: Callable[[], float] = time.time, keep_seconds: int = KEEP_SECONDS, telemetry: Telemetry | None = None):
        self.engine, self.names, self.profile, self.mode, self.clock, self.keep = engine, PROFILES[profile], profile, mode, clock, keep_seconds
        self.telemetry, self.hits, self.misses = telemetry or Telemetry("off", ""), 0, 0
        self.kept, self.until = Kept(engine.store.revision, MOST_KEPT), {}

    def list(self) -> tuple[str, ...]:
        return self.names

    def call(self, name: str, arguments: dict | None = None) -> dict:
        """content (text by the response mode), structuredContent, isError; problems are answers, too."""
        try:
            if name not in self.names:
                raise ValueError(f"Tool unavailable in profile '{self.profile}': {name}")
            if self.engine.store.read_only and name in WRITES:
                raise PermissionError(f"Tool is disabled in read-only mode: {name}")
            data, failed = self._answer(name, dict(arguments or {})), False
        except Exception as problem:  # whatever a tool raises is its answer
            data, failed = {"error": str(problem)}, True
        self.telemetry.emit("tool_call", tool=name, ok=not failed)
        line = summary(data, failed)
        text = json.dumps(data, ensure_ascii=False, indent=2, default=str) if self.mode == "verbose" else f"{line}\nstructuredContent contains the complete payload." if self.mode == "balanced" else line
        return {"content": [{"type": "text", "text": text}], "structuredContent": {"items": data, "count": len(data)} if isinstance(data, list) else data, "isError": failed}

    def _answer(self, name: str, a: dict):
        if name not in KEPT or self.keep <= 0:
            return self._run(name, a)
        key, made = stable_hash({"tool": name, "arguments": a, "profile": self.profile}), []
        if key in self.until and self.until[key] <= self.clock():
            self.kept.answers.pop(key, None)

        def make():
            made.append(key)
            return self._run(name, a)

        data = self.kept.get(key, a["project_key"], make)
        if made:
            self.misses += 1
            self.until[key] = self.clock() + self.keep
            self.until = {k: t for k, t in self.until.items() if k in self.kept.answers}
        else:
            self.hits += 1
        return data

    def _run(self, name: str, a: dict):
        e, now, project = self.engine, int(self.clock()), a.get("project_key")
        session, limit = a.get("session_id"), lambda default, most: max(1, min(int(a.get("limit", default)), most))
        scope_of = lambda: (project, a.get("hint"), a.get("current_cwd"), a.get("repo_path"), tuple(a.get("mentioned_files") or ()))
        if project is not None and name not in ("mem_note_create", "mem_search", "mem_recent") and not e.store.read("projects", project).head(1):
            raise ValueError("Project not found")
        if name == "mem_search":
            return self._rows(e.search(a.get("query", ""), project, limit(10, 50), session, now))
        if name == "mem_recent":
            return self._rows(e.recent(project, limit(10, 50), session, now))
        if name == "mem_get":
            return self._one(e.get(int(a["observation_id"])), "Observation not found")
        if name == "mem_provenance":
            return self._one(e.provenance(project, int(a["observation_id"])), "Provenance not found")
        if name == "mem_note_create":
            tags = a.get("tags") if isinstance(a.get("tags"), list) else [a["tags"]] if a.get("tags") is not None else []
            row = (project, session, str(a["text"]), a.get("title"), [str(t) for t in tags], a.get("importance"))
            return self._rows(e.note_create(e.spark.createDataFrame([row], _NOTE), now))
        if name == "mem_session_list":
            return self._rows(e.session_list(project, a.get("query"), limit(20, 100), a.get("sub_scope_hint")))
        if name == "mem_scope_resolve":
            return e.scope_routing(*scope_of(), limit(8, 20))
        if name == "mem_bootstrap_context":
            hints = dict.fromkeys(" ".join(str(a[k]).split()) for k in ("hint", "thread_hint", "chat_title", "active_chat_label") if a.get(k))
            return e.bootstrap_context(project, " ".join(hints) or None, *scope_of()[2:], session, a.get("budget", "micro"), now)
        if name == "mem_project_brief":
            return e.project_brief(project, session, now)
        if name == "mem_open_work":
            return self._rows(e.open_work(project, session, now))
        if name == "mem_completion_check":
            return self._one(e.completion_check(project, session, now, record=not e.store.read_only), "Project not found")
        if name == "mem_recent_changes":
            return self._rows(e.recent_changes(project, session_id=session, now=now))
        if name == "mem_scope_guard":
            return self._rows(e.scope_guard(project, session, now))
        if name == "mem_context_pack":
            return e.context_pack(project, a.get("max_chars"), a.get("budget", "auto"), session, now, a.get("known_pack_hash"))
        if name == "mem_health":
            return e.health(project, now)
        if name == "mem_health_runtime":
            return e.health_runtime(now) | {"cache_hits": self.hits, "cache_misses": self.misses, "profile": self.profile, "read_only": e.store.read_only}
        if name == "mem_snapshot_list":
            return self._rows(e.snapshot_list(project).limit(limit(20, 100)))
        if name == "mem_snapshot_create":
            return e.snapshot_create(project, str(a["label"]), now, session)
        if name == "mem_snapshot_restore":
            return e.snapshot_restore(project, str(a["snapshot_id"]), now)
        if name == "mem_policy_list":
            return self._rows(e.policy_list(project))
        if name == "mem_policy_validate":
            return e.policy_validate(str(a["policy_kind"]), a.get("rule") or {})
        if name == "mem_policy_add":
            e.policy_add(project, a.get("policy_id") or stable_hash([project, a, now])[:16], str(a["policy_kind"]), a.get("rule") or {}, now, bool(a.get("enabled", True)))
            return self._rows(e.policy_list(project))
        if name == "mem_policy_remove":
            return {"removed": e.policy_remove(project, str(a["policy_id"]), now)}
        if name == "mem_inheritance_list":
            return self._rows(e.inheritance_list(project))
        if name == "mem_inheritance_add":
            e.inheritance_add(project, a.get("link_id") or stable_hash([project, a, now])[:16], str(a["source_project_key"]), str(a["mode"]), now, a.get("selector"), bool(a.get("enabled", True)))
            return self._rows(e.inheritance_list(project))
        if name == "mem_inheritance_remove":
            return {"removed": e.inheritance_remove(project, str(a["link_id"]), now)}
        if name == "mem_repair_propose":
            return self._rows(e.repair_propose(project, now))
        return {"applied": e.repair_apply(project, str(a["repair_kind"]), now)}

    @staticmethod
    def _rows(rows: DataFrame) -> list[dict]:
        return [r.asDict(True) for r in rows.limit(MOST_ROWS).collect()]

    def _one(self, rows: DataFrame, missing: str) -> dict:
        found = rows.first()
        if found is None:
            raise ValueError(missing)
        return found.asDict(True)
