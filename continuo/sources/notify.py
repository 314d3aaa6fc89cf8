"""Notification payloads as envelopes: messages of any shape as texts, and the project that a payload names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from continuo.operators import identity

#: Fields that name the project, fields with texts that may mention paths.
PROJECT_FIELDS = ("project_key", "project-key", "project_name", "project-name", "workspace_key", "workspace-key", "workspace_name", "workspace-name")
TEXT_FIELDS = (
    "input-messages", "input_messages", "input", "prompt", "request", "user-message", "user_message", "last-assistant-message", "last_assistant_message",
    "assistant-response", "assistant_response", "response", "output",
)
WINDOWS_PATH, POSIX_PATH = r"[A-Za-z]:[\\/][^\s`\"<>|]+", r"(?<!\w)/(?:[^\s`\"<>|]+/)*[^\s`\"<>|]+"


def _text(x: Column) -> Column:
    """A JSON value as text: strings as they are, objects by their text or content, else their JSON."""
    kind = F.schema_of_variant(x)
    part = lambda name: F.when(F.schema_of_variant(F.try_variant_get(x, f"$.{name}", "variant")) == "STRING", F.try_variant_get(x, f"$.{name}", "string"))
    plain = F.try_variant_get(x, "$", "string")
    return F.when(kind == "STRING", plain).when(kind.startswith("OBJECT"), F.coalesce(part("text"), part("content"), F.to_json(x))).when(kind != "VOID", F.coalesce(plain, F.to_json(x)))


def texts(value: Column) -> Column:
    """The texts of a JSON value that is a list of messages, one message, or nothing; empty ones are left out."""
    several = F.transform(F.try_variant_get(value, "$", "array<variant>"), _text)
    one = F.array(_text(value))
    every = F.when(F.schema_of_variant(value).startswith("ARRAY"), several).otherwise(one)
    return F.coalesce(F.filter(every, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def mentioned(said: Column) -> Column:
    """The distinct paths in texts, Windows ones of a text first, without punctuation behind them."""
    found = F.flatten(F.transform(said, lambda t: F.concat(F.regexp_extract_all(t, F.lit(WINDOWS_PATH), F.lit(0)), F.regexp_extract_all(t, F.lit(POSIX_PATH), F.lit(0)))))
    return F.array_distinct(F.filter(F.transform(found, lambda p: F.regexp_replace(F.trim(p), r"[.,;:)\]}'\"]+$", "")), lambda p: p != ""))


def notify_to_envelope(payloads: DataFrame, project_key: str | None = None, project_from_cwd: bool = False, files: DataFrame | None = None) -> DataFrame:
    """agent-turn-complete payloads (JSON in ``value``) as envelopes with metadata; other types are left out.

    With a listing of ``files`` (path, text) projects are known by the marks of their roots, else by names of folders alone.
    """
    rows = payloads.withColumn("p", F.try_parse_json("value"))
    get = lambda *names: F.coalesce(*[F.nullif(F.try_variant_get("p", f'$["{n}"]', "string"), F.lit("")) for n in names])
    raw = lambda *names: F.coalesce(*[F.try_variant_get("p", f'$["{n}"]', "variant") for n in names])
    rows = rows.where(get("type") == "agent-turn-complete")
    named = [identity.usable(F.when(F.schema_of_variant(raw(n)) == "STRING", get(n))) for n in PROJECT_FIELDS]
    rows = rows.withColumns({"payload_key": F.coalesce(*named), "cwd": get("cwd", "cwd_path"), "said": F.flatten(F.array(*[texts(raw(n)) for n in TEXT_FIELDS]))})
    rows = rows.withColumn("paths", mentioned(F.col("said")))
    if files is None or project_key:
        rows = rows.withColumn("places", identity.by_names(F.col("cwd"), F.col("paths")))
    else:
        rows = identity.looked_up(rows, files)
    rows = rows.withColumn("who", identity.identity(project_key, F.col("payload_key"), F.col("cwd"), F.col("places"), project_from_cwd))
    about = {
        "notification_type": get("type"), "model_name": get("model", "model-name", "model_name"), "project_resolution_source": F.col("who.source"), "project_resolution_confidence": F.col("who.confidence"),
        "project_resolution_warnings": F.nullif(F.array_join("who.warnings", ","), F.lit("")), "project_root_path": F.col("who.root_path"),
    }
    metadata = F.map_filter(F.create_map(*[x for name, value in about.items() for x in (F.lit(name), value)]), lambda _, v: v.isNotNull())
    reply = F.coalesce(*[F.get(texts(raw(n)), 0) for n in ("last-assistant-message", "last_assistant_message")])
    return rows.select(
        F.lit("codex").alias("runtime"), F.col("who.project_key").alias("project_key"), F.coalesce(get("thread-id", "thread_id"), F.lit("unknown-session")).alias("session_id"),
        F.coalesce(get("turn-id", "turn_id"), F.lit("unknown-turn")).alias("turn_id"), get("cwd").alias("cwd"), get("timestamp", "emitted-at").alias("timestamp"),
        texts(raw("input-messages", "input_messages")).alias("input_messages"), F.coalesce(reply, F.lit("")).alias("assistant_message"), metadata.alias("metadata"), F.col("value").alias("raw_payload"),
    )
