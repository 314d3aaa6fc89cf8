"""Extraction of labelled facts, open-work state, completion checks, health and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from continuo.functions import text as T

_AFTER = r"\s*[:\-]\s*(.+)$"
_DOD = "dod|definition of done"
#: Kinds with their labels, importance and confidence; the first that fits wins. Claims and decisions have
#: patterns of their own.
KINDS = (
    ("objective", "objective|goal|target|mission", 4, 0.72),
    ("constraint", "constraint|restriction|rule", 4, 0.7),
    ("project_dod", rf"project\s+(?:{_DOD})", 5, 0.76),
    ("mission_dod", rf"mission\s+(?:{_DOD})", 5, 0.76),
    ("session_dod", rf"session\s+(?:{_DOD})|{_DOD}", 5, 0.74),
    ("pending_item", "pending|todo|to do|remaining|open item", 5, 0.74),
    ("completed_item", "done|completed|finished", 3, 0.7),
    ("blocker", "blocker|blocked|risk", 5, 0.78),
)
CLAIM = r"(?i)^\s*(?:status\s*[:\-]\s*(?:done|complete|completed|finished)|(?:we are|we're|it is)\s+(?:done|finished|complete(?:d)?))\s*$"
DECISION = r"(?iu)^\s*(?:[-*]\s*(?:decision|decisión)|decision|decisión|resolved|resolution)\s*[:\-]\s*(.+)$"
#: Before a label inside a line; a bare definition of done doesn't follow the word that makes it another kind.
_BARE = rf"(?<!project )(?<!mission )(?<!session )(?:{_DOD})"
_LABELS = [labels.removesuffix(_DOD) + _BARE if kind == "session_dod" else labels for kind, labels, _, _ in KINDS]
INLINE = rf"(?i)\s+(?=(?:decision|decisión|{'|'.join(_LABELS)}|status)\s*[:\-])"
DOD = ("project_dod", "mission_dod", "session_dod")
#: Calls of the memory's own tools; a turn that makes one, or asks for an exact answer, holds no facts.
TOOLS = "search|get|recent|project_brief|open_work|completion_check|recent_changes|scope_guard|context_pack|provenance|health|snapshot_(?:list|create|restore)"
DIAGNOSTIC = rf"(?i)\b(?:use|call|invoke)\b.{{0,160}}\bmem_(?:{TOOLS})\b|respond exactly as\s*:|without using tools or reading files"
#: Titles, importance and confidence of the kinds that no label names.
TITLES = {"objective": "Objective", "user_request": "User request", "constraint": "Constraint", "project_dod": "Project DoD", "mission_dod": "Mission DoD", "session_dod": "Session DoD", "pending_item": "Pending", "completed_item": "Completed", "blocker": "Blocker", "completion_claim": "Completion claim", "decision": "Decision"}
WEIGHTS = {kind: (importance, confidence) for kind, _, importance, confidence in KINDS} | {"completion_claim": (5, 0.62), "user_request": (4, 0.38), "decision": (4, 0.75)}
#: What an open state forbids.
GUARDRAILS = (
    "Do not declare completion while pending work remains.",
    "Before closing, confirm each pending item explicitly.",
    "Keep the active user request in scope; do not silently narrow it.",
    "If blockers remain, say blocked and list them instead of saying done.",
    "Do not declare completion while Definition of Done items are still missing.",
    "A recent completion claim conflicts with open pending work. Re-check scope before closing.",
    "A recent completion claim conflicts with Definition of Done gaps. Re-check closure before closing.",
)
#: Profiles in order with the limits that open work must fit.
BUDGETS = (("micro", 3, 2, 2, 2, 0), ("normal", 4, 3, 3, 3, 1), ("full", 6, 4, 5, 4, 2))


def _split(text: Column, pattern: str, limit: int = -1) -> Column:
    """The parts of a text; a split makes its pattern anew each time, so a text that has nothing to split is left alone."""
    return F.when(text.rlike(pattern), F.split(text, pattern, limit)).otherwise(F.array(text))


def segment_list(text: Column) -> Column:
    """(line, cut, part, segment) of a text in order: lines, cut at semicolons and before inline labels."""
    part = lambda line, cut: lambda t, k: F.struct(line.alias("line"), cut.alias("cut"), k.alias("part"), T.strip(t).alias("segment"))
    stripped = lambda x: F.transform(x, T.strip)
    cut = lambda line: lambda t, k: F.transform(_split(t, INLINE), part(line, k))
    lines = F.transform(stripped(F.split(text, T.LINE_END)), lambda t, k: F.flatten(F.transform(stripped(_split(t, r"\s*;\s*")), cut(k))))
    return F.filter(F.flatten(lines), lambda x: x["segment"] != "")


def segments(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """``keys``, line, cut, part, segment."""
    return rows.select(*keys, F.inline(segment_list(F.col(text))))


def clean_value(value: Column) -> Column:
    """One line, up to the first sentence end that a capital follows."""
    squashed = F.regexp_replace(T.squash(value), r"^[ -]+|[ -]+$", "")
    return F.trim(F.regexp_extract(squashed, r"(?s)^(.*?)(?:(?<=[.!?])\s+(?=[A-Z]).*)?\z", 1))


def _facts(segments_: Column) -> Column:
    """(kind, normalized, line, cut, part, value) of segments; no kind if one has no label.

    One pass for the kind, one for what stands behind its label, one for the normal form: each reads the pass before it,
    so no pattern is tried twice on a segment.
    """
    place = lambda x: (x["line"], x["cut"], x["part"])
    patterns = [rf"(?i)^\s*(?:{labels}){_AFTER}" for _, labels, _, _ in KINDS]

    def labelled(x: Column) -> Column:
        which = F.when(x["segment"].rlike(CLAIM), -1)
        for k, pattern in enumerate(patterns):
            which = which.when(x["segment"].rlike(pattern), k)
        return F.struct(which.alias("which"), x["segment"].alias("segment"), *place(x))

    def valued(x: Column) -> Column:
        which, segment = x["which"], x["segment"]
        kind, value = F.when(which == -1, "completion_claim"), F.when(which == -1, "assistant claimed the work was complete")
        for k, pattern in enumerate(patterns):
            kind, value = kind.when(which == k, KINDS[k][0]), value.when(which == k, clean_value(F.regexp_extract(segment, pattern, 1)))
        return F.struct(kind.alias("kind"), value.alias("value"), segment.alias("segment"), *place(x))

    def normal(x: Column) -> Column:
        text = F.when(x["kind"] == "completion_claim", x["segment"]).otherwise(x["value"])
        return F.struct(x["kind"].alias("kind"), T.normalize_state(text).alias("normalized"), *place(x), x["value"].alias("value"))

    found = F.filter(F.transform(segments_, labelled), lambda x: x["which"].isNotNull())
    return F.transform(F.transform(found, valued), normal)


def _decisions(segments_: Column) -> Column:
    """The same of segments that state a decision, others with an empty value."""
    valued = lambda x: F.struct(F.trim(F.regexp_extract(x["segment"], DECISION, 1)).alias("value"), x["line"], x["cut"], x["part"])
    fact = lambda x: F.struct(F.lit("decision").alias("kind"), T.normalize_state(x["value"]).alias("normalized"), x["line"], x["cut"], x["part"], x["value"].alias("value"))
    return F.transform(F.transform(segments_, valued), fact)


def _found(rows: DataFrame, segments_: str, facts, name: str) -> DataFrame:
    """Adds ``name``: the facts of a column of segments, each (kind, normal form) once, where it stands first.

    All in the row: facts are sorted by what makes them equal, and one stays that differs from the one before it.
    """
    fits = lambda x: x["kind"].isNotNull() & ~x["normalized"].isin("", "and", "or")
    sorted_ = F.array_sort(F.filter(facts(F.col(segments_)), fits))
    before = lambda k: F.get(F.col("__sorted"), k - 1)
    new = lambda x, k: (k == 0) | (x["kind"] != before(k)["kind"]) | (x["normalized"] != before(k)["normalized"])
    return rows.withColumn("__sorted", sorted_).withColumn(name, F.filter("__sorted", new)).drop("__sorted")


def extract(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """``keys``, line, cut, part, kind, value, normalized: the labelled facts of each text, nothing shuffled."""
    cut = rows.select(*keys, segment_list(F.coalesce(text, F.lit(""))).alias("__segments"))
    found = _found(cut, "__segments", _facts, "__facts").select(*keys, F.inline("__facts"))
    return found.select(*keys, "line", "cut", "part", "kind", "value", "normalized")


def decisions(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """Decisions of a text, each normal form once."""
    cut = rows.select(*keys, segment_list(F.coalesce(text, F.lit(""))).alias("__segments"))
    found = _found(cut, "__segments", _decisions, "__facts").select(*keys, F.inline("__facts"))
    return found.select(*keys, "line", "cut", "part", "kind", "value", "normalized")


def request(text: Column) -> Column:
    """The first 280 characters of a message's lines."""
    lines = F.filter(F.transform(F.split(text, T.LINE_END), T.strip), lambda x: x != "")
    return F.substring(F.trim(F.array_join(lines, " | ")), 1, 280)


def summarize(messages: Column, reply: Column) -> Column:
    """The last two messages and up to 400 characters of the reply on one line."""
    said = T.strip(F.array_join(F.when(F.size(messages) <= 2, messages).otherwise(F.slice(messages, -2, 2)), " | "))
    line = F.replace(T.strip(reply), F.lit("\n"), F.lit(" "))
    line = F.when(F.length(line) > 400, F.concat(F.substring(line, 1, 397), F.lit("..."))).otherwise(line)
    return T.strip(F.concat(F.when(said == "", "No user message").otherwise(said), F.lit(" -> "), line))


def turn_observations(events: DataFrame, *keys: str, tool: str | None = None) -> DataFrame:
    """All observations of turns: a summary, the reply's decisions, labelled facts and the request of each message.

    events: ``keys``, runtime, input_messages, assistant_message; null messages count as none. Turns that only probe
    the memory give nothing; ``tool`` names the tool whose use by name counts as such. Facts are distinct within one
    message, not across them. Output: ``keys``, type, title, summary, detail, importance, confidence, status.
    A turn's rows come out of its own row, so payloads of equal keys never mix.
    """
    probe = DIAGNOSTIC + (rf"|use the {tool} mcp tool" if tool else "")
    none = F.array().cast("array<string>")
    own = [k for k in keys if k != "runtime"]
    turns = events.select(*own, F.coalesce("runtime", F.lit("")).alias("runtime"), F.array_compact(F.coalesce("input_messages", none)).alias("messages"), F.coalesce("assistant_message", F.lit("")).alias("reply"))
    turns = turns.where(~F.array_join("messages", "\n").rlike(probe))
    title = F.concat("runtime", F.lit(" turn summary")).alias("title")
    summary = turns.select(*keys, F.lit("session_summary").alias("type"), title, summarize(F.col("messages"), F.col("reply")).alias("summary"), F.substring("reply", 1, 8000).alias("detail"), F.lit(2).alias("importance"), F.lit(0.45).alias("confidence"), F.lit("snapshot").alias("status"))
    said = F.transform("messages", lambda m: F.struct(F.lit(False).alias("reply"), m.alias("text")))
    texts = turns.select(*keys, F.inline(F.concat(said, F.array(F.struct(F.lit(True).alias("reply"), F.col("reply").alias("text"))))))
    texts = texts.withColumn("__segments", segment_list(F.col("text")))
    texts = _found(_found(texts, "__segments", _facts, "__facts"), "__segments", _decisions, "__decisions")
    asked = F.struct(F.lit("user_request").alias("kind"), F.lit("").alias("normalized"), F.lit(0).alias("line"), F.lit(0).alias("cut"), F.lit(0).alias("part"), request(F.col("text")).alias("value"))
    every = F.concat("__facts", F.when(F.col("reply"), F.col("__decisions")).otherwise(F.array(asked)))
    found = texts.select(*keys, "text", F.explode(F.filter(every, lambda x: x["value"] != "")).alias("x"))
    kind, value = F.col("x.kind"), F.col("x.value")
    entry = lambda of: F.create_map(*[F.lit(x) for k, v in of.items() for x in (k, v)])[kind]
    facts = found.select(
        *keys, kind.alias("type"), F.concat(entry(TITLES), F.lit(": "), F.substring(value, 1, 72)).alias("title"), value.alias("summary"), F.substring("text", 1, 8000).alias("detail"),
        entry({k: w[0] for k, w in WEIGHTS.items()}).alias("importance"), entry({k: w[1] for k, w in WEIGHTS.items()}).alias("confidence"), F.lit("active").alias("status"),
    )
    return summary.unionByName(facts)


def open_work(items: DataFrame, key: str) -> DataFrame:
    """The open items of a state: pending ones and definitions of done that nothing completed resolves, and blockers.

    items: the bounded state items (key, type, pos, id, summary, normalized, updated_at), see ``changes.state_items``.
    """
    done = items.where("type = 'completed_item'").alias("d")
    todo = items.where(F.col("type").isin("pending_item", *DOD)).alias("p")
    meets = (F.col(f"p.{key}") == F.col(f"d.{key}")) & T.state_matches(F.col("p.normalized"), F.col("d.normalized"))
    return todo.join(done, meets, "left_anti").unionByName(items.where("type = 'blocker'")).select(key, "type", "pos", "id", "summary", "normalized", "updated_at")


def counts(items: DataFrame, open_items: DataFrame, key: str) -> DataFrame:
    """Counts of a state: what is open, evidence, claims and the rest, one row a group."""
    of = lambda *kinds: F.count(F.when(F.col("type").isin(*kinds), 1))
    whole = items.groupBy(key).agg(of("completed_item").alias("evidence"), of("completion_claim").alias("claims"), of("constraint").alias("constraints"), of("objective").alias("objectives"), of("user_request").alias("requests"), of(*DOD).alias("dod_total"))
    left = open_items.groupBy(key).agg(of("pending_item").alias("pending"), of("blocker").alias("blockers"), of(*DOD).alias("dod_missing"))
    return whole.join(left, key, "left").fillna(0, ["pending", "blockers", "dod_missing"])


def guardrails(counted: DataFrame) -> DataFrame:
    """Adds guardrails: what the state forbids, in a fixed order."""
    has = lambda c: F.col(c) > 0
    said = F.array_compact(F.array(*[F.when(condition, F.lit(text)) for condition, text in (
        (has("pending"), GUARDRAILS[0]), (has("pending"), GUARDRAILS[1]), (has("requests"), GUARDRAILS[2]), (has("blockers"), GUARDRAILS[3]),
        (has("dod_missing"), GUARDRAILS[4]), (has("claims") & has("pending"), GUARDRAILS[5]), (has("claims") & has("dod_missing"), GUARDRAILS[6]),
    )]))
    return counted.withColumn("guardrails", said)


def objective(items: DataFrame, key: str) -> DataFrame:
    """key, objective: the kept objective, else the first request."""
    ranked = F.struct((F.col("type") != "objective").alias("later"), "pos", "summary")
    return items.where("type in ('objective', 'user_request')").groupBy(key).agg(F.min(ranked).alias("x")).select(key, F.col("x.summary").alias("objective"))


def scope_guard(items: DataFrame, open_items: DataFrame, key: str) -> DataFrame:
    """key, must_not_drop, flags: texts that a pack must keep, in order of kind, and why the work is not closed."""
    order = {"constraint": 1, "pending_item": 2, "blocker": 3, "project_dod": 4, "mission_dod": 5, "session_dod": 6}
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("type")]
    marked = items.join(open_items.select(key, "type", "pos", F.lit(True).alias("open")), [key, "type", "pos"], "left")
    kept = F.when((F.col("type") == "constraint") | F.coalesce("open", F.lit(False)), F.struct(place.alias("place"), "pos", "summary"))
    first = F.when(F.col("type").isin("objective", "user_request"), F.struct((F.col("type") != "objective").alias("later"), "pos", "summary"))
    listed = marked.groupBy(key).agg(F.min(first)["summary"].alias("first"), F.array_sort(F.collect_list(kept))["summary"].alias("rest"))
    texts = F.array_distinct(F.filter(F.concat(F.array("first"), "rest"), lambda x: F.coalesce(x, F.lit("")) != ""))
    texts = listed.select(key, F.when(F.size(texts) > 0, texts).alias("must_not_drop"))
    checked = completion_check(counts(items, open_items, key))
    flags = F.array_compact(F.array(F.when(F.col("closure_mismatch"), "closure_mismatch"), F.when(F.col("pending") > 0, "pending_work_open"), F.when(F.col("blockers") > 0, "blockers_open"), F.when(F.col("dod_missing") > 0, "dod_incomplete")))
    return checked.join(texts, key, "left").select(key, "must_not_drop", flags.alias("flags"))


def unresolved(items: DataFrame, key: str) -> DataFrame:
    """Pending items that no completed item of the same group matches."""
    pending, done = items.where("kind = 'pending_item'").alias("p"), items.where("kind = 'completed_item'").alias("d")
    meets = (F.col(f"p.{key}") == F.col(f"d.{key}")) & T.state_matches(F.col("p.normalized"), F.col("d.normalized"))
    return pending.join(done, meets, "left_anti")


def fold_dedupe(items: DataFrame, *keys: str, limit: int) -> DataFrame:
    """Greedy fuzzy dedupe in order: an item stays unless it matches one kept before; at most ``limit`` stay.

    Order matters and matching is not transitive, so each group's ordered texts are folded. items: pos, normalized.
    """
    ordered = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "normalized"))).alias("xs"))
    empty = F.array().cast("array<struct<pos:bigint,normalized:string>>")
    step = lambda kept, x: F.when(F.exists(kept, lambda k: T.state_matches(k["normalized"], x["normalized"])), kept).otherwise(F.concat(kept, F.array(F.struct(x["pos"].cast("long").alias("pos"), x["normalized"].alias("normalized")))))
    return ordered.select(*keys, F.explode(F.slice(F.aggregate("xs", empty, step), 1, limit)).alias("x")).select(*keys, "x.pos", "x.normalized")


def completion_check(counted: DataFrame) -> DataFrame:
    """Ordered reasons; done without any; mismatch if done is claimed all the same."""
    reasons = F.array_compact(F.array(F.when(F.col("pending") > 0, "pending_items_open"), F.when(F.col("blockers") > 0, "blockers_open"), F.when(F.col("dod_missing") > 0, "dod_incomplete"), F.when(F.col("evidence") == 0, "missing_evidence")))
    done = F.size(reasons) == 0
    return counted.withColumn("reasons", F.array_join(reasons, ",")).withColumn("done", done).withColumn("primary_reason", F.coalesce(F.get(reasons, 0), F.lit("ready_to_close"))).withColumn("closure_mismatch", (F.col("claims") > 0) & ~done)


def auto_budget(counted: DataFrame) -> DataFrame:
    """The smallest profile whose limits cover the counts, else full."""
    budget, reason = F.lit("full"), F.lit("requires_full_profile")
    for name, pending, blockers, dod, constraints, summaries in reversed(BUDGETS):
        fits = (F.col("pending") <= pending) & (F.col("blockers") <= blockers) & (F.col("dod_missing") <= dod) & (F.col("constraints") <= constraints) & (F.col("summaries") <= summaries)
        budget, reason = F.when(fits, name).otherwise(budget), F.when(fits, "fits_open_work_profile").otherwise(reason)
    return counted.withColumn("budget", budget).withColumn("budget_reason", reason)


def health(counted: DataFrame) -> DataFrame:
    """100 less capped penalties for duplicates, contradictions, stale and missing items, within 0 and 100. Columns: surplus, contradictions, stale, dod_missing."""
    capped = lambda c, each, most: F.least(F.col(c) * each, F.lit(most))
    score = F.lit(100) - capped("surplus", 4, 20) - capped("contradictions", 15, 45) - capped("stale", 3, 15) - capped("dod_missing", 8, 24)
    return counted.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long"))
