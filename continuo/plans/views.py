"""The logical tables of the continuity model over the columnar tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from continuo.plans.session import steady

#: Observation types, in order of doc_id modulo 12, and their retrieval priority.
TYPES = ("pending_item", "blocker", "project_dod", "mission_dod", "session_dod", "objective", "constraint", "user_request", "decision", "completed_item", "completion_claim", "session_summary")
PRIORITY = (0, 1, 2, 2, 2, 3, 3, 3, 4, 5, 6, 7)
MEANINGFUL = tuple(t for t in TYPES if t not in ("user_request", "decision", "session_summary"))
PROTECTED = ("blocker", "completion_claim", "constraint", "mission_dod", "objective", "pending_item", "project_dod", "session_dod")
#: Labels that turns carry, by turn modulo 8.
LABELS = ("Objective", "Pending", "Blocker", "Done", "Constraint", "Project DoD", "Decision", "Todo")
EPOCH = 1_767_225_600


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return steady(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, status: bool = True) -> DataFrame:
    """Documents as observations; only with ``status`` are their labels read and joined."""
    rows = read(spark, sf_dir, "documents")
    if status:
        rows = rows.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
        label = F.when(F.col("quality") == 1, "active").when(F.col("quality") == 0, "low_value").otherwise("snapshot")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % 12 + 1).cast("int"))
    return rows.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("project_key"),
        (F.col("doc_id") % 50).alias("session_id"),
        kind.alias("type"),
        F.element_at(F.array(*map(F.lit, PRIORITY)), (F.col("doc_id") % 12 + 1).cast("int")).alias("priority"),
        F.substring("text", 1, 72).alias("title"),
        F.substring("text", 1, 280).alias("summary"),
        F.col("text").alias("detail"),
        *([label.alias("status")] if status else []),
        (1 + F.col("doc_id") % 5).alias("importance"),
        (F.lit(EPOCH) + F.col("doc_id")).alias("updated_at"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("turn") % 8 + 1).cast("int"))
    return read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 7).alias("project_id"), F.col("conv_id").alias("session_id"), "turn", "role", "text",
        (F.lit(EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("captured_at"),
        F.concat(label, F.lit(": "), "text", F.lit("; Blocker: "), "role", F.lit(" access still missing")).alias("labelled"),
    )


def sync_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("budget"), (F.col("event_type") == "error").alias("skipped"), (F.col("user_id") % 7).alias("project_id"),
        (F.col("value") / 1000).alias("compression_ratio"), F.col("value").alias("build_ms"), F.unix_micros(F.col("ts").cast("timestamp")).alias("generated_at"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


#: Tags that notes carry, by id modulo 4.
NOTE_TAGS = ("release, data quality", "freeze", "local-install", "Café notes, baseline")


def notes(spark: SparkSession, sf_dir: str, status: bool = True) -> DataFrame:
    """Every observation as a manual note with a line of tags."""
    tags = F.element_at(F.array(*map(F.lit, NOTE_TAGS)), (F.col("id") % 4 + 1).cast("int"))
    return observations(spark, sf_dir, status).withColumn("detail", F.concat("detail", F.lit("\n\nTags: "), tags))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages: some sessions open with a title prompt, some wrap the user's prompt, all name a path."""
    at, key = F.col("turn"), F.col("session_id")
    named = F.concat(F.lit("see /srv/app/data-"), (key % 3).cast("string"), F.lit("/x and tool-"), (key % 4).cast("string"), F.lit(" "), "text")
    text = F.when((key % 4 == 0) & (at % 2 == 0), F.concat(F.lit("Generate a short title. "), "text")).when(key % 4 == 1, F.concat(F.lit("Context. User prompt: "), "text")).otherwise(named)
    return turns(spark, sf_dir).select("session_id", at.alias("pos"), text.alias("text"), "captured_at")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("session_id")
    cwd = F.concat(F.lit("/work/team-"), (key % 5).cast("string"), F.when(key % 6 == 0, "/docs").otherwise(F.concat(F.lit("/repo-"), (key % 9).cast("string"))))
    found = turns(spark, sf_dir).groupBy("session_id").agg(F.max("captured_at").alias("last_turn_at"), F.count("*").alias("turns"))
    return found.select("session_id", F.concat(F.lit("conv-"), key.cast("string")).alias("external_id"), cwd.alias("cwd"), "last_turn_at", "turns")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the files of folders that sessions work in or messages name: guides, state files, manifests, notes."""
    key, team = F.col("doc_id"), F.col("doc_id") % 5
    repo = F.concat(F.lit("/work/team-"), team.cast("string"), F.lit("/repo-"), (key % 9).cast("string"))
    kind, name = key % 9, F.concat(F.lit("scope-"), team.cast("string"), F.lit("-"), (key % 9).cast("string"))
    guide = F.concat(F.lit("# Guide\nScope: `"), name, F.lit("`\n"), "text")
    state = F.concat(F.lit("# State\n\nNombre canonico:\n\n- `"), name, F.lit("`\n"), "text")
    number = lambda n: (key % n).cast("string")
    path = F.when(kind < 3, F.concat(repo, F.lit("/AGENTS.md"))).when(kind < 5, F.concat(repo, F.lit("/PROJECTS_STATE_"), number(7), F.lit(".md")))
    path = path.when(kind == 5, F.concat(repo, F.lit("/pyproject.toml"))).when(kind == 6, F.concat(F.lit("/srv/app/data-"), number(2), F.lit("/.git/"), key.cast("string")))
    return read(spark, sf_dir, "documents").select(path.otherwise(F.concat(repo, F.lit("/notes/"), key.cast("string"))).alias("path"), F.when(kind < 3, guide).when(kind < 5, state).alias("text"))


#: The same tables in the SQL of the oracles.
_LIST = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
_PRIO = "[" + ", ".join(map(str, PRIORITY)) + "]"
_LABELS = "[" + ", ".join(f"'{t}'" for t in LABELS) + "]"
_TAGS = "[" + ", ".join(f"'{t}'" for t in NOTE_TAGS) + "]"
SQL = f"""
WITH observations AS (SELECT d.doc_id AS id, source AS project_key, d.doc_id % 50 AS session_id, {_LIST}[d.doc_id % 12 + 1] AS type, {_PRIO}[d.doc_id % 12 + 1] AS priority,
 substr(text, 1, 72) AS title, substr(text, 1, 280) AS summary, text AS detail, CASE quality WHEN 1 THEN 'active' WHEN 0 THEN 'low_value' ELSE 'snapshot' END AS status,
 1 + d.doc_id % 5 AS importance, {EPOCH} + d.doc_id AS updated_at FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
turns AS (SELECT conv_id % 7 AS project_id, conv_id AS session_id, turn, role, text, {EPOCH} + conv_id * 3600 + turn * 60 AS captured_at,
 {_LABELS}[turn % 8 + 1] || ': ' || text || '; Blocker: ' || role || ' access still missing' AS labelled FROM conversations),
sync AS (SELECT event_id, event_type AS budget, event_type = 'error' AS skipped, user_id % 7 AS project_id, value / 1000 AS compression_ratio, value AS build_ms,
 epoch_us(ts) AS generated_at, (props->>'$.k')::BIGINT AS k FROM events),
notes AS (SELECT * REPLACE (detail || chr(10) || chr(10) || 'Tags: ' || {_TAGS}[id % 4 + 1] AS detail) FROM observations),
messages AS (SELECT session_id, turn AS pos, captured_at, CASE WHEN session_id % 4 = 0 AND turn % 2 = 0 THEN 'Generate a short title. ' || text WHEN session_id % 4 = 1 THEN 'Context. User prompt: ' || text
 ELSE 'see /srv/app/data-' || session_id % 3 || '/x and tool-' || session_id % 4 || ' ' || text END AS text FROM turns),
sessions AS (SELECT session_id, 'conv-' || session_id AS external_id, '/work/team-' || session_id % 5 || CASE WHEN session_id % 6 = 0 THEN '/docs' ELSE '/repo-' || session_id % 9 END AS cwd,
 max(captured_at) AS last_turn_at, count(*) AS turns FROM turns GROUP BY session_id)
"""
