"""Sessions: labels, inferred sub-scopes, resolution of hints to sessions, and lanes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from continuo.functions import folding as fd
from continuo.functions.text import squash
from continuo.operators.notes import meaningful

#: Phrases of title prompts, broad folder names, names that never narrow a search, name patterns.
PROMPT_NOISE = ("generate a concise ui title", "generate a clear, informative task title", "generate a short title", "the tasks typically have to do with coding-related tasks", "fill the structured title field")
BROAD = ("lab", "src", "docs", "tests", "scripts", "workspace")
NEVER_NARROW = (
    "ambient", "appdata", "classifier", "local", "policy", "policy-classifier", "policy-safety", "program-files", "program-files-x86", "programdata", "roaming", "safety", "safety-classifier", "self-harm", "system32", "temp", "tmp", "users", "windows",
)
PATHS = r"(?:[A-Za-z]:[\\/][^\n`\"']+|/[A-Za-z0-9_.\-/]+)"
REPO_NAME = r"\b[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)+\b"
#: Points of a literal sub-scope, folder or session match, and of an equal path hint.
SCOPE_POINTS, FOLDER_POINTS, SESSION_POINTS, PATH_POINTS = 80, 60, 220, 100


def is_noise(text: Column) -> Column:
    lowered = F.lower(squash(text))
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(p)) for p in PROMPT_NOISE])


def shorten(text: Column, limit: int) -> Column:
    line = squash(text)
    return F.when(F.length(line) > limit, F.concat(F.rtrim(F.substring(line, 1, limit - 3)), F.lit("..."))).otherwise(line)


def is_broad(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return low.isin(*BROAD) | low.startswith("__") | low.endswith("_workspace") | low.endswith("_root")


def first_operational(messages: DataFrame, key: str) -> DataFrame:
    """key, text, source, suppressed: the first message of each session that people wrote.

    Blank messages and title prompts are passed over; what follows ``user prompt:`` counts as the message. Only the
    first message and two flags are aggregated, so a session of any length needs one small buffer. messages: key,
    pos, text. Sessions with nothing but noise get an empty text and the source ``fallback``.
    """
    line = messages.select(key, "pos", squash(F.coalesce("text", F.lit(""))).alias("line")).where("line <> ''")
    inner = shorten(F.regexp_extract("line", r"(?is)user prompt:\s*(.+)\z", 1), 300)
    line = line.withColumn("inner", inner).withColumn("noise", is_noise(F.col("line")) & (F.col("inner") == ""))
    pick = F.struct("pos", F.when(F.col("inner") != "", F.col("inner")).otherwise(F.col("line")).alias("text"), (F.col("inner") != "").alias("embedded"))
    found = line.groupBy(key).agg(F.min(F.when(~F.col("noise"), pick)).alias("m"), F.min(F.when(F.col("noise"), F.col("pos"))).alias("noise_at"))
    source = F.when(F.col("m").isNull(), "fallback").when(F.col("m.embedded"), "embedded_user_prompt").otherwise("first_input")
    before = F.col("noise_at").isNotNull() & (F.col("m").isNull() | (F.col("noise_at") < F.col("m.pos")))
    found = found.select(key, F.coalesce("m.text", F.lit("")).alias("text"), source.alias("source"), (before | F.coalesce("m.embedded", F.lit(False))).alias("suppressed"))
    return messages.select(key).distinct().join(found, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("fallback")).alias("source"), F.coalesce("suppressed", F.lit(False)).alias("suppressed"))


def infer_sub_scope(sessions: DataFrame, key: str) -> DataFrame:
    """key, sub_scope, candidates, source, confidence: the name mentioned most, ties in folded order.

    sessions: key (unique), cwd, text. Names come from the folder, from paths and from hyphenated words of the text;
    sessions without any name are left out.
    """
    names = F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(REPO_NAME), F.lit(0)), lambda n: ~is_broad(n))
    good = lambda part: part.rlike(f"^(?:{REPO_NAME})$") & ~is_broad(part)
    last_good = lambda path: F.try_element_at(F.filter(F.transform(F.split(F.translate(path, "\\", "/"), "/"), F.trim), good), F.lit(-1))
    paths = F.array_compact(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(PATHS), F.lit(0)), last_good))
    leaf = fd.path_leaf(F.col("cwd"))
    folder = F.when(leaf.isNotNull() & ~is_broad(leaf), F.array(leaf)).otherwise(F.array().cast("array<string>"))
    tagged = lambda xs, source: F.transform(xs, lambda n: F.struct(n.alias("name"), F.lit(source).alias("source")))
    every = sessions.select(key, F.posexplode(F.concat(tagged(folder, "cwd_leaf"), tagged(paths, "path_mention"), tagged(names, "text_mention"))).alias("pos", "c"))
    counted = every.groupBy(key, F.col("c.name").alias("name")).agg(F.count("*").alias("n"), F.min(F.struct("pos", "c.source")).alias("first"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), F.lower("name"), "first.pos")
    top = counted.withColumn("rn", F.row_number().over(order)).where("rn <= 5")
    best = F.min(F.struct("rn", "name", "n", "first.source")).alias("best")
    out = top.groupBy(key).agg(best, F.array_sort(F.collect_list(F.struct("rn", "name"))).alias("names"))
    sure = (F.col("best.n") > 1) | F.col("best.source").isin("cwd_leaf", "path_mention")
    return out.select(key, F.col("best.name").alias("sub_scope"), F.col("names.name").alias("candidates"), F.col("best.source").alias("source"), F.when(sure, "medium").otherwise("low").alias("confidence"))


def label(sessions: DataFrame, messages: DataFrame, key: str) -> DataFrame:
    """Sessions with sub_scope, display_label and preview. sessions: key, external_id, cwd."""
    joined = sessions.join(first_operational(messages, key), key, "left").withColumn("text", F.coalesce("text", F.lit("")))
    named = joined.join(infer_sub_scope(joined.select(key, "cwd", "text"), key).select(key, "sub_scope", "candidates"), key, "left")
    prefix = F.coalesce("sub_scope", "external_id")
    shown = F.when(F.col("text") != "", F.concat(prefix, F.lit(" · "), F.col("text"))).otherwise(F.col("external_id"))
    return named.withColumns({"display_label": shorten(shown, 120), "preview": shorten(F.col("text"), 180), "low_value": (F.col("text") == "") & F.coalesce("suppressed", F.lit(False))})


def lane_of(*values: Column) -> Column:
    """The first last path part that can narrow a search (lower case, hyphen or underscore, not a common name), else null."""
    def fits(leaf: Column) -> Column:
        folded = fd.fold(leaf)
        policy = F.contains(folded, F.lit("classifier")) & (F.contains(folded, F.lit("policy")) | F.contains(folded, F.lit("safety")))
        shaped = (F.length(leaf) <= 96) & (leaf == F.lower(leaf)) & leaf.rlike(r"^[\p{L}\p{N}_.-]*[-_][\p{L}\p{N}_.-]*$")
        return shaped & ~folded.isin(*NEVER_NARROW) & ~policy & ~is_broad(leaf) & ~leaf.endswith("_lab")

    return F.get(F.filter(F.array(*map(fd.path_leaf, values)), fits), 0)


def matches(session: DataFrame, *terms: str | None) -> DataFrame:
    """Sessions whose label, previews, ids, folder and names hold every term that is not blank."""
    fields = [F.col(c) for c in ("display_label", "preview", "external_id", "cwd", "sub_scope")] + [F.array_join("candidates", " ")]
    hay = F.lower(F.concat_ws(" ", *fields))
    return session.where(reduce(lambda a, b: a & b, [F.contains(hay, F.lit(t.lower())) for t in terms if t and t.strip()], F.lit(True)))


def resolve(sessions: DataFrame, hint: str | None = None, current_cwd: str | None = None, repo_path: str | None = None, files: tuple[str, ...] = (), limit: int = 10) -> DataFrame:
    """session_id, lane, score, signals, matched, confidence of the sessions that the hints point to, best first.

    sessions: session_id, external_id, cwd, sub_scope, display_label, preview, last_turn_at. Without hints every
    session that has a lane is listed with score 0, newest first. The hints are read once on the driver.
    """
    leaf_of = lambda path: path.replace("\\", "/").rstrip("/").split("/")[-1] if path else ""
    given = [" ".join(v.split()) for v in (hint, current_cwd, repo_path, *files) if v and v.strip()]
    text = " ".join(part for v in given for part in dict.fromkeys((v, leaf_of(v))) if part)
    folded, words = fd.fold_query(text), meaningful(fd.query_tokens(text))
    path_hints = [fd.fold_query(leaf_of(p)) for p in (current_cwd, repo_path) if p and leaf_of(p)]
    rows = sessions.withColumn("lane", lane_of(F.col("sub_scope"), F.col("cwd")))
    if not text:
        listed = rows.where("lane is not null").select("session_id", "lane", F.lit(0).alias("score"), F.array().cast("array<string>").alias("signals"), F.array().cast("array<string>").alias("matched"), "last_turn_at")
    else:
        lane, leaf = fd.fold(F.col("lane")), fd.fold(fd.path_leaf(F.col("cwd")))
        inside = lambda part: (part != "") & F.contains(F.lit(folded), part)
        label_words = fd.tokens(F.concat_ws(" ", "display_label", "preview", "external_id"))
        wanted = F.array(*map(F.lit, sorted(words))) if words else F.array().cast("array<string>")
        by_lane, by_label = F.array_intersect(fd.tokens(F.col("lane")), wanted), F.array_intersect(label_words, wanted)
        equal_paths = reduce(lambda a, b: a + b, [((lane == p) | (leaf == p)).cast("int") for p in path_hints], F.lit(0))
        points = {
            "inferred_sub_scope_literal_match": F.when(inside(lane), SCOPE_POINTS), "cwd_leaf_literal_match": F.when(inside(leaf), FOLDER_POINTS),
            "external_session_id_literal_match": F.when(fd.fold(F.col("external_id")) == folded, SESSION_POINTS), "path_hint_exact_match": F.when(equal_paths > 0, equal_paths * PATH_POINTS),
            "sub_scope_token_match": F.when(F.size(by_lane) > 0, F.least(F.size(by_lane) * 30, F.lit(90))), "session_label_token_match": F.when(F.size(by_label) > 0, F.least(F.size(by_label) * 8, F.lit(40))),
        }
        total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in points.values()])
        signals = F.array_sort(F.array_compact(F.array(*[F.when(p.isNotNull(), name) for name, p in points.items()])))
        listed = rows.select("session_id", "lane", total.alias("score"), signals.alias("signals"), F.array_sort(F.array_union(by_lane, by_label)).alias("matched"), "last_turn_at")
    order = [F.desc("score"), F.desc_nulls_last("last_turn_at"), F.desc("session_id")]
    best = listed.orderBy(*order).limit(max(2, limit))
    best = best.where("score > 0") if text else best  # after the limit: below it the score would be worked out twice
    ranked = best.withColumn("rn", F.row_number().over(Window.orderBy(*order)))  # at most ``limit`` rows
    ranked = ranked.withColumn("second", F.coalesce(F.lead("score").over(Window.orderBy("rn")), F.lit(0)))
    first = F.when((F.col("rn") == 1) & (F.col("score") >= 150) & (F.col("score") >= F.col("second") + 45), "high")
    ranked = ranked.withColumn("confidence", first.when(F.col("score") >= 70, "medium").otherwise("low"))
    return ranked.where(F.col("rn") <= limit).drop("second")


#: Sessions that a scope lists at most, and names that it lists.
LISTED_SESSIONS, LISTED_NAMES = 100, 8


def lanes(sessions: DataFrame, limit: int = 8) -> DataFrame:
    """lane, session_count, session_ids (the 8 smallest), latest_turn_at, top_score, signals, matched; best lanes first, 1 to 20.

    sessions: session_id, sub_scope, cwd, last_turn_at, score, and signals and matched (lists of names) if they were scored.
    The ids are cut to 8 a lane before they are collected; signals and matched words are those of a few hints.
    """
    rows = sessions.withColumn("lane", lane_of(F.col("sub_scope"), F.col("cwd"))).where("lane is not null")
    order = Window.partitionBy("lane").orderBy("session_id")
    few = rows.select("lane", "session_id").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= LISTED_NAMES)
    ids = few.groupBy("lane").agg(F.array_sort(F.collect_list("session_id")).alias("session_ids"))
    whole = rows.groupBy("lane").agg(F.count("*").alias("session_count"), F.max("last_turn_at").alias("latest_turn_at"), F.max("score").alias("top_score"))
    joined = whole.join(ids, "lane")
    for name in ("signals", "matched"):
        if name in rows.columns:
            each = rows.select("lane", F.explode(name).alias(name)).groupBy("lane").agg(F.array_sort(F.collect_set(name)).alias(name))
            joined = joined.join(each, "lane", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return joined.orderBy(F.desc("top_score"), F.desc_nulls_last("latest_turn_at"), F.desc("session_count"), F.desc("lane")).limit(max(1, min(limit, 20)))


def confidence(top: int, second: int = 0) -> str:
    return "high" if top >= 150 and top >= second + 45 else "medium" if top >= 70 else "low"


def routing(hinted: bool, found: list[dict], lanes_: list[dict], sessions: int) -> dict:
    """Where resolved hints lead: found are the resolver's rows, lanes_ those of ``lanes``; never a session by itself."""
    broad = sessions > 1 or len(lanes_) > 1
    sure = found[0]["confidence"] if hinted and found else "low"
    if not hinted:
        decision = "needs_hint"
    elif not found:
        decision = "no_match"
    elif sure == "high" or len(lanes_) == 1:
        decision = "lane_resolved"
    else:
        decision = "ambiguous"
    return {
        "routing_decision": decision, "confidence": sure, "candidates": found, "candidate_lanes": lanes_, "session_count": sessions, "multiple_sessions_detected": sessions > 1,
        "multiple_lanes_detected": len(lanes_) > 1, "broad_scope_detected": broad, "do_not_fetch_project_wide_pack": broad or decision != "needs_hint",
        "signals_used": sorted({x for r in found for x in r["signals"] or ()}), "recommended_scope": found[0]["lane"] if sure == "high" else None,
    }


def notices(scope: dict) -> list[str]:
    """The lines of a pack that say which sessions it is made of. scope: see ``Engine.scope_metadata``."""
    if not scope["session_filter_applied"] and not scope["broad_scope_detected"]:
        return []
    sessions, names = scope["source_session_count"], scope["source_sub_scope_count"]
    if scope["session_filter_applied"]:
        lines = [f"Session scope: session-scoped; session_filter=applied; source_sessions={sessions}; external_session_id={scope['source_sessions'][0] if scope['source_sessions'] else 'unknown'}."]
    else:
        lines = [
            f"Session scope: project-wide; session_filter=not_applied; source_sessions={sessions}; sub_scopes={names}.",
            "Scope warning: mixed persisted sessions/sub-scopes. Use `mem_session_list` + `session_id`.",
            "No active objective selected: this project-wide pack is advisory until narrowed.",
            'Suggested narrowing: choose a target from candidate_sub_scopes, then call mem_session_list(project_key, query="<target sub-scope>") before treating this project-wide pack as active context.',
        ]
    last, captured = scope["last_operational_capture_at"], scope["last_captured_turn_at"]
    if last:
        beside = f" (last captured turn: `{captured}`)" if captured and captured != last else ""
        lines.append(f"Last operational capture: `{last}`{beside}. Persisted; not live current-turn awareness.")
    elif captured:
        lines.append(f"Last captured turn: `{captured}`. Persisted; not live current-turn awareness.")
    return lines


def short_notices(lines: list[str]) -> list[str]:
    """Those that very small packs keep."""
    return [x for x in lines if not x.startswith(("Suggested narrowing:", "No active objective selected:"))]
