"""Manual notes: creation, a declarative relevance score, the fallback and the merge with ranked search."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from continuo.functions import folding as fd
from continuo.functions.text import SQL_TRIMMED, squash

#: Words, tags and phrases that the score knows.
HIGH_VALUE_TAGS = {
    "baseline": ("actual", "baseline", "current", "estado", "state", "version"),
    "blocker": ("blocker", "bloqueada", "bloqueado", "bloqueante", "bloqueo", "pendiente", "pendientes"),
    "current-state": ("actual", "current", "estado", "state", "version"),
    "decision": ("autorizacion", "decision", "decidir", "explicit", "final"),
    "freeze": ("bloqueada", "bloqueado", "cierre", "congelada", "congelado", "freeze", "frozen", "hold"),
    "governance": ("gobernanza", "governance", "policy", "protocolo"),
    "installation-state": ("instalada", "instalado", "instalacion", "installation", "local", "runtime"),
    "publish-hold": ("assets", "checksums", "github", "hold", "publicacion", "publicar", "publish", "release", "tag"),
    "release": ("assets", "checksums", "github", "publicacion", "publicar", "publish", "release", "tag"),
    "roadmap": ("plan", "planes", "roadmap", "roadmaps"),
    "version-state": ("actual", "baseline", "estado", "instalada", "instalado", "version"),
}
HIDDEN_STATUSES = ("low_value", "retired", "superseded")
STOPWORDS = {"a", "al", "and", "con", "de", "del", "el", "en", "for", "la", "las", "los", "of", "on", "para", "por", "the", "to", "un", "una", "y"}
GENERIC = {"audit", "auditoria", "auditorias", "auditar", "code", "codigo", "doc", "docs", "documento", "documentos", "manifest", "manifiesto", "package", "packages", "paquete", "paquetes", "plan", "planes", "pro", "report", "reporte", "reportes", "reports", "roadmap", "roadmaps"}
META_TAGS = ("local-install", "manual-note-search", "mcp-internal", "relevance-gate", "test", "validation")
META_WORDS = {"debug", "diagnostic", "gate", "install", "internal", "local", "manual", "meta", "note", "relevance", "search", "smoke", "test", "validation"}
ALIASES = (
    {"bloqueada", "bloqueado", "cierre", "congelada", "congelado", "freeze", "frozen", "hold"},
    {"github", "publicacion", "publicar", "publish", "release"},
    {"site", "sitio", "sitios", "website", "websites"},
)
STABLE_PHRASES = ("baseline", "do not publish", "do not touch", "explicit approval", "final decision", "freeze tecnico", "frozen assets", "hashes", "human diff ready", "installed version", "publish pending", "release hold")


def meaningful(words: set[str]) -> set[str]:
    return {w for w in words if len(w) > 1 and not w.isdigit()} - STOPWORDS - GENERIC


def opaque_identifier(query: str) -> str | None:
    """The folded query if it is one word of 8 characters at least with a digit and one of ``_:.-``."""
    bare = query.strip()
    one_word = len(bare) >= 8 and not re.search(r"\s", bare)
    return fd.fold_query(bare) or None if one_word and re.search(r"\d", bare) and re.search("[_:.-]", bare) else None


def _words(words) -> Column:
    return F.array(*map(F.lit, sorted(words))) if words else F.array().cast("array<string>")


def _hits(column: Column, words) -> Column:
    return F.size(F.array_intersect(column, _words(words))) if words else F.lit(0)


def score(notes: DataFrame, query: str) -> DataFrame:
    """id, note_score of the notes that pass both gates; blank queries and hidden notes give none.

    Everything about the query is worked out once; the notes are read in one projection without shuffle.
    notes: id, title, summary, detail, status, importance. Null texts count as empty, null importance as 0.
    """
    words, folded, opaque = fd.query_tokens(query), fd.fold_query(query), opaque_identifier(query)
    if not words:
        return notes.select("id", F.lit(0.0).alias("note_score")).where("false")
    asked = meaningful(words)
    weak = {w for w in words if len(w) == 1 or w.isdigit()}
    groups = [g for g in ALIASES if g & words]
    boostable = {tag for tag, near in HIGH_VALUE_TAGS.items() if set(near) & words}
    has = lambda column: F.contains(F.col(column), F.lit(folded))

    rows = notes.where(~F.lower(F.coalesce("status", F.lit(""))).isin(*HIDDEN_STATUSES)).select(
        "id", F.lower(F.coalesce("status", F.lit(""))).alias("status"), F.coalesce(F.col("importance").cast("int"), F.lit(0)).alias("importance"),
        fd.fold(F.col("title")).alias("title"), fd.fold(F.col("summary")).alias("summary"), fd.fold(F.col("detail")).alias("detail"), fd.detail_tags(F.col("detail")).alias("raw_tags"),
    )
    rows = rows.withColumn("tag_text", fd.fold(F.array_join("raw_tags", " "))).withColumn("tags", F.array_distinct(F.filter(F.transform("raw_tags", fd.tag_key), lambda t: t != "")))
    rows = rows.withColumn("body", squash(F.concat_ws(" ", "title", "summary", "detail", "tag_text")))
    rows = rows.withColumn("title_words", fd.tokens(F.col("title"))).withColumn("body_words", fd.tokens(F.col("body")))

    specific = lambda t: ~t.isin(*HIGH_VALUE_TAGS) & (F.contains(F.lit(folded), t) | (_hits(F.split(t, "-"), asked) >= 2))
    identifier = F.col("body").rlike(rf"(?<![a-z0-9]){re.escape(opaque)}(?![a-z0-9])") if opaque else F.lit(False)
    alias_groups = reduce(lambda a, b: a + b, [(_hits(F.col("body_words"), g) > 0).cast("int") for g in groups], F.lit(0))
    facts = {
        "direct": _hits(F.col("body_words"), asked), "weak": _hits(F.col("body_words"), weak), "in_title": _hits(F.col("title_words"), asked),
        "alias": _hits(F.col("body_words"), set().union(*groups) - words), "alias_groups": alias_groups,
        "boosted": _hits(F.col("tags"), boostable), "specific": F.size(F.filter("tags", specific)),
        "stable": reduce(lambda a, b: a + b, [F.contains("body", F.lit(p)).cast("int") for p in STABLE_PHRASES]),
        "meta": F.arrays_overlap("tags", _words(META_TAGS)), "meta_title": _hits(F.col("title_words"), asked & META_WORDS),
        "identifier": identifier, "literal": has("body"), "same_title": F.col("title") == folded,
        "title_literal": has("title"), "body_literal": has("summary") | has("detail"), "tag_literal": has("tag_text"),
    }
    rows = rows.withColumns(facts)
    relevant = F.expr("alias_groups > 0 or in_title >= 1 or direct >= 2 or specific > 0 or (boosted > 0 and direct > 0) or literal or identifier")
    allowed = F.expr("not meta or specific > 0 or meta_title >= 2 or identifier")
    #: Weight, most and count of each signal; weights of the yes/no signals.
    counted = ((4.0, 6, "direct"), (0.5, 4, "weak"), (2.0, 4, "alias"), (3.0, 9, "alias_groups"), (4.0, 4, "boosted"), (3.0, 3, "specific"), (2.0, 3, "in_title"), (2.0, 4, "stable"), (4.0, 2, "greatest(0, importance - 3)"))
    flags = ((8.0, "importance >= 4"), (80.0, "identifier"), (60.0, "same_title"), (40.0, "literal and not same_title"), (20.0, "title_literal"), (14.0, "body_literal"), (10.0, "tag_literal"), (2.0, "status in ('active', 'promoted')"))
    parts = [F.least(F.expr(what), F.lit(most)) * weight for weight, most, what in counted] + [F.when(F.expr(what), weight).otherwise(0.0) for weight, what in flags]
    scored = F.struct("id", reduce(lambda a, b: a + b, parts, F.lit(8.0)).alias("note_score"))
    return rows.select(F.inline(F.when(relevant & allowed, F.array(scored))))  # a filter would be pushed down and work everything out twice


def candidates(notes: DataFrame, limit: int = 50) -> DataFrame:
    """Important visible notes for queries that find nothing, best first."""
    shown = notes.where(~F.lower(F.coalesce("status", F.lit(""))).isin(*HIDDEN_STATUSES) & (F.col("importance") >= 4))
    return shown.orderBy(F.desc("importance"), F.desc("updated_at"), F.desc("id")).limit(limit)


def merge_ranked(found: DataFrame, scored: DataFrame, notes: DataFrame, limit: int = 10) -> DataFrame:
    """Ranked hits and scored notes in one list: notes without score drop out, the higher score of an id stays.

    found: id, priority, rank, updated_at. scored: id, note_score. notes: the rows of all notes. Order: score, type
    priority, rank, newest, id.
    """
    plain = found.join(notes.select("id"), "id", "left_anti").select("id", "priority", "rank", "updated_at", F.lit(0.0).alias("score"))
    ranked = notes.join(scored, "id").join(found.select("id", "rank"), "id", "left").select("id", "priority", F.coalesce("rank", F.lit(0.0)).alias("rank"), "updated_at", F.col("note_score").alias("score"))
    return plain.unionByName(ranked).orderBy(F.desc("score"), "priority", "rank", F.desc("updated_at"), "id").limit(limit)


def merge_scored(found: DataFrame, scored: DataFrame, asked: DataFrame) -> DataFrame:
    """Found rows and scored notes in one table with ``score``: found notes without a score drop out, other rows have 0.

    found: rows with rank. asked: the rows of the notes that were scored. scored: id, note_score.
    """
    plain = found.where("coalesce(source_kind, '') <> 'manual_note'").withColumn("score", F.lit(0.0))
    noted = asked.join(scored, "id").join(found.select("id", "rank"), "id", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    return plain.unionByName(noted.withColumnRenamed("note_score", "score").select(*plain.columns))


def create(raw: DataFrame, one_line: Callable[[Column], Column] = squash, blanks: bool = False) -> DataFrame:
    """Notes as observations. raw: project_key, session_id, text, title, tags, importance. Blank and null texts give no row, unless ``blanks``.

    ``one_line`` says what white space is. The first note of equal content stays; its key hashes project, session, title, text and tags.
    """
    tags = F.array_distinct(F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), one_line), lambda t: t != ""))
    rows = raw.withColumns({"text": one_line(F.col("text")), "title": F.coalesce(one_line(F.col("title")), F.lit("")), "tags": tags})
    if not blanks:
        rows = rows.where("text <> ''")
    title = F.when(F.col("title") != "", F.col("title")).otherwise(F.concat(F.lit("Manual note: "), F.rtrim(F.substring("text", 1, 80), F.lit(SQL_TRIMMED))))
    rows = rows.withColumn("title", title)
    rows = rows.select(
        "project_key", "session_id", F.lit("session_summary").alias("type"), "title", F.col("text").alias("summary"),
        F.concat(F.col("text"), F.when(F.size("tags") > 0, F.concat(F.lit("\n\nTags: "), F.array_join("tags", ", "))).otherwise("")).alias("detail"),
        F.lit(1.0).alias("confidence"), F.least(F.greatest(F.coalesce(F.col("importance").cast("int"), F.lit(3)), F.lit(1)), F.lit(5)).alias("importance"), F.lit("active").alias("status"), F.lit("manual_note").alias("source_kind"),
        F.sha2(F.to_json(F.struct("project_key", "session_id", "tags", "text", "title")), 256).alias("dedupe_hash"),
    )
    first = Window.partitionBy("dedupe_hash").orderBy("importance")
    return rows.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")
