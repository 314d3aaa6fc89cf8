"""A log of events as JSON lines, rotated by size, and hashes of JSON in one stable spelling."""

from __future__ import annotations

import hashlib
import json
import time
from pathlib import Path

#: The events of the short log, and the least size at which it is rotated.
SUMMARY = ("process_start", "initialize", "tools_list", "tool_call", "idle_timeout", "stdin_eof", "signal", "process_exit")
LEAST_BYTES = 10_000


def stable_json(value) -> str:
    """ASCII, keys in order, no spaces."""
    return json.dumps(value, ensure_ascii=True, sort_keys=True, separators=(",", ":"), default=str)


def stable_hash(value) -> str:
    return hashlib.sha256(stable_json(value).encode()).hexdigest()


class Telemetry:
    """mode: off, summary (the events of SUMMARY) or debug (all). The log is a file of the driver's machine."""

    def __init__(self, mode: str, folder: str, max_bytes: int = 1_000_000, clock=time.time):
        self.mode, self.path, self.max_bytes, self.clock = mode, Path(folder) / "events.jsonl", max(LEAST_BYTES, max_bytes), clock

    def emit(self, event: str, **fields) -> None:
        if self.mode != "debug" and not (self.mode == "summary" and event in SUMMARY):
            return
        self.path.parent.mkdir(parents=True, exist_ok=True)
        if self.path.exists() and self.path.stat().st_size >= self.max_bytes:
            self.path.replace(self.path.with_suffix(".jsonl.1"))
        with self.path.open("a", encoding="utf-8") as log:
            log.write(stable_json({"at": self.clock(), "event": event, **fields}) + "\n")
