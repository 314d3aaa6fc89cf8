"""One method a tool over a store: reads give DataFrame plans or a few rows' dictionary, writes append.

Questions of one project look at bounded rows (the newest 480, 20 decisions, 100 sessions); what governance leaves of
them is worked out once for each state of the store and kept as a small local table that further plans start from.
What is kept stands until anybody writes to the project or to one that it inherits from.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from continuo.functions.folding import slug
from continuo.kept import Kept
from continuo.operators import changes, governance, metrics, notes, pack, portfolio, retrieval, scope, search, state
from continuo.plans.schemas import TABLES
from continuo.plans.scratch import cut
from continuo.plans.views import MEANINGFUL, PRIORITY, TYPES
from continuo.sources.notify import notify_to_envelope
from continuo.sources.store import SESSION, TURN, Store

#: Marks around the generated part of a document, and the documents it may be in.
BLOCK_START, BLOCK_END = "<!-- generated-context:start -->", "<!-- generated-context:end -->"
DOCUMENTS = ("AGENTS.override.md", "AGENTS.md")
NOT_SMALLER = "context_pack_not_smaller_than_source"
#: What processes that live show.
ALIVE_SECONDS, STORM = 120, 5
#: What governance says of an item.
JUDGED = ("never_archive", "retrieval_excluded", "pack_excluded", "keep_priority")
#: States and packs that an engine keeps at most.
KEPT_ANSWERS = 64


def managed_block(document: str, block: str) -> str:
    """The document with its marked part replaced, or with one at its end."""
    marked = f"{BLOCK_START}\n{block}\n{BLOCK_END}"
    found = re.compile(re.escape(BLOCK_START) + ".*?" + re.escape(BLOCK_END), re.S)
    return found.sub(lambda _: marked, document, count=1) if found.search(document) else f"{document.rstrip()}\n\n{marked}\n"


def block_text(made: dict) -> str:
    """A pack with the lines that say how it was made."""
    return "\n".join((
        "## Generated Context", "", f"> Budget: `{made['budget']}`", f"> Approx pack size: ~{made['pack_tokens']} tokens from ~{made['source_tokens']} source tokens.",
        f"> Budget reason: `{made['budget_reason'] or 'explicit_or_default'}`", "> This block is generated after completed turns to keep continuity compact across sessions.", "", made["text"],
    ))


def local(rows: DataFrame) -> DataFrame:
    """Rows that a limit has bounded to a few hundred, as a table of the driver that further plans start from."""
    return rows.sparkSession.createDataFrame(rows.coalesce(1).collect(), rows.schema)


class Effective:
    """What policies, inheritance and repairs leave of a project's (or session's) bounded rows."""

    def __init__(self, engine: Engine, project_key: str, session_id: str | None, now: int):
        spark = engine.spark
        self.policies, self.links = engine.policies(project_key), engine.links(project_key)
        self.rules = list(self.policies)
        inherited_rows, inherited_decisions = [], []
        if session_id is None:
            for source, mode, chosen in self.links:
                if mode in governance.RULES_PASS:
                    self.rules += engine.policies(source)
                if mode in governance.OBSERVATIONS_PASS:
                    inherited_rows.append(engine.inheritable(source, chosen, now))
                if mode in governance.DECISIONS_PASS:
                    inherited_decisions.append(engine.inheritable_decisions(source, chosen))
        repaired = engine.store.read("repairs", project_key).select("id")
        plain = {"item_key": F.concat(F.lit("observation:"), F.col("id").cast("string")), "inherited_from": F.lit(None).cast("string")}
        rows = engine.retrievable(project_key, session_id).where(F.col("type").isin(*changes.STATE_LIMITS))
        rows = rows.orderBy(F.desc("updated_at"), F.desc("id")).limit(changes.NEWEST_ROWS).withColumns(plain).withColumn("tags", F.array().cast("array<string>"))
        names = ("item_key", "id", "project_key", "session_id", "type", "title", "summary", "detail", "status", "updated_at", "tags", "inherited_from")
        rows = reduce(lambda a, b: a.unionByName(b), [x.select(*names) for x in (rows, *inherited_rows)])
        made = engine.decision_rows(project_key, session_id).withColumns(plain | {"item_key": F.concat(F.lit("decision:"), F.col("id").cast("string"))})
        made = reduce(lambda a, b: a.unionByName(b), [x.select(*names) for x in (made, *inherited_decisions)])
        judged = lambda frame: local(governance.effects(frame, self.rules, now, repaired).select(*names, *JUDGED))
        # a few hundred rows: the newest of the project and those of its links
        self.all_rows, self.all_decisions = judged(rows), judged(made)
        self._ordered: dict[str, DataFrame] = {}
        self._state: tuple[DataFrame, DataFrame] | None = None

    def _in_order(self, rows: DataFrame, hidden: str) -> DataFrame:
        """Own rows first, then inherited ones, each with priority ahead and the oldest first; with ``key`` and ``pos``."""
        order = [F.col("inherited_from").isNotNull(), F.when(F.col("keep_priority"), 0).otherwise(1), "updated_at", F.coalesce(F.col("id").cast("string"), F.col("item_key"))]
        rows = rows.where(~F.col(hidden)).withColumn("key", F.lit(1))
        return rows.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy(*order)))

    def rows(self, hidden: str = "retrieval_excluded") -> DataFrame:
        if hidden not in self._ordered:
            self._ordered[hidden] = local(self._in_order(self.all_rows, hidden))
        return self._ordered[hidden]

    def decisions(self, hidden: str = "retrieval_excluded") -> DataFrame:
        order = [F.when(F.col("keep_priority"), 0).otherwise(1), "updated_at", F.coalesce(F.col("id").cast("string"), F.col("item_key"))]
        rows = self.all_decisions.where(~F.col(hidden)).withColumn("key", F.lit(1))
        return rows.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy(*order)))

    def state(self) -> tuple[DataFrame, DataFrame]:
        """The state's items and its open ones."""
        if self._state is None:
            items = local(changes.state_items(self.rows().where(F.col("pos") <= changes.STATE_ROWS), "key"))
            self._state = items, local(state.open_work(items, "key"))
        return self._state

    def hidden(self, column: str) -> list[int]:
        return [r.id for r in self.all_rows.where(F.col(column) & F.col("id").isNotNull()).select("id").collect()]


class Portfolio:
    """What governance leaves of the bounded rows of all projects, as plans over the store's tables."""

    def __init__(self, engine: Engine, now: int):
        store = engine.store
        policies = portfolio.numbered(store.latest("policies", ("project_key", "policy_id")), "policy_id")
        links = portfolio.numbered(store.latest("inheritances", ("project_key", "link_id")), "link_id")
        few = max(policies.count(), links.count()) <= portfolio.FEW
        own_rules, all_rules = portfolio.rules(policies), portfolio.rules(policies, links)
        repaired, tags = store.read("repairs"), F.array().cast("array<string>")
        plain = lambda place: {"item_key": F.concat(F.lit(f"{place}:"), F.col("id").cast("string")), "inherited_from": F.lit(None).cast("string"), "tags": tags}
        newest = [F.desc("updated_at"), F.desc("id")]
        rows = engine.retrievable(None).where(F.col("type").isin(*changes.STATE_LIMITS))
        rows = changes.leading(rows, ["project_key"], changes.NEWEST_ROWS, *newest).withColumns(plain("observation"))
        made = store.decisions().withColumns({"type": F.lit("decision"), "summary": F.col("decision_text"), "detail": F.col("decision_text")})
        made = changes.leading(made, ["project_key"], pack.DECISION_ROWS, *newest).withColumns(plain("decision"))
        # what a source passes on is what its own rules leave of its newest rows
        sources = changes.leading(rows, ["project_key"], changes.EARLIER_ROWS, *newest)
        sources = portfolio.effects(sources, own_rules, now, repaired, few).where("not retrieval_excluded")
        passed = portfolio.inherited(sources, links, governance.OBSERVATIONS_PASS, "observation", few)
        aged = made.withColumn("age", F.row_number().over(Window.partitionBy("project_key").orderBy(*newest)))
        decided = portfolio.inherited(aged, links, governance.DECISIONS_PASS, "decision", few)
        both = lambda a, b: a.select(*portfolio.NAMES).unionByName(b.select(*portfolio.NAMES))
        self.rows = portfolio.effects(both(rows, passed), all_rules, now, repaired, few)
        self.decisions = portfolio.effects(both(made, decided), all_rules, now, repaired, few)

    def states(self) -> tuple[DataFrame, DataFrame]:
        """The state's items and its open ones of every project."""
        return portfolio.states(portfolio.visible(self.rows))


class Engine:
    def __init__(self, spark: SparkSession, base: str, read_only: bool = False):
        self.spark, self.store = spark, Store(spark, base, read_only)
        self._kept = Kept(self.store.revision, KEPT_ANSWERS)

    # -- rows

    def observations(self, project_key: str | None = None, session_id: str | None = None) -> DataFrame:
        """Observations of one project or all, with their retrieval priority."""
        rows = self.store.observations(project_key)
        if session_id is not None:
            rows = rows.where(F.col("session_id") == self.session(project_key, session_id))
        place = F.create_map(*[F.lit(x) for pair in zip(TYPES, PRIORITY, strict=True) for x in pair])
        return rows.withColumn("priority", F.coalesce(place[F.col("type")], F.lit(50)))

    def session(self, project_key: str, session_id: str) -> str:
        """The session if it is one of the project's; nobody reads another project's session."""
        if not self.store.read("sessions", project_key).where(F.col("session_id") == session_id).head(1):
            raise ValueError("Session not found for project")
        return session_id

    def retrievable(self, project_key: str | None, session_id: str | None = None) -> DataFrame:
        """Observations beside what their sessions say: folder, root, a warning where they were captured outside it.

        Without a session filter, rows of sessions outside their root are left out.
        """
        rows = self.observations(project_key, session_id)
        about = self.store.sessions(project_key).select(*SESSION, "cwd", "root_path", "root_match", "warning", "producer_version")
        rows = rows.join(about, list(SESSION), "left").withColumn("root_match", F.coalesce("root_match", F.lit(True)))
        return rows if session_id is not None else rows.where(F.col("root_match") | F.col("session_id").isNull())

    def policies(self, project_key: str) -> list[tuple[str, dict]]:
        """Enabled rules, oldest first: people write them, so they are few."""
        rows = self.policy_list(project_key).where("enabled").orderBy("at", "policy_id").collect()
        return [(r.kind, json.loads(r.rule)) for r in rows]

    def links(self, project_key: str) -> list[tuple[str, str, dict]]:
        rows = self.inheritance_list(project_key).where("enabled").orderBy("at", "link_id").collect()
        return [(r.source_key, r.mode, json.loads(r.selector or "{}")) for r in rows]

    def decision_rows(self, project_key: str, session_id: str | None = None, limit: int = pack.DECISION_ROWS) -> DataFrame:
        """The newest decisions as items."""
        rows = self.store.decisions(project_key)
        rows = rows if session_id is None else rows.where(F.col("session_id") == session_id)
        rows = rows.orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)
        return rows.withColumns({"type": F.lit("decision"), "summary": F.col("decision_text"), "detail": F.col("decision_text"), "tags": F.array().cast("array<string>")})

    def inheritable(self, source: str, chosen: dict, now: int) -> DataFrame:
        """The newest rows of a source project that its own rules leave and the link's selector takes."""
        rows = self.retrievable(source).where(F.col("type").isin(*changes.STATE_LIMITS)).orderBy(F.desc("updated_at"), F.desc("id")).limit(changes.EARLIER_ROWS)
        judged = governance.effects(rows, self.policies(source), now, self.store.read("repairs", source).select("id")).where("not retrieval_excluded")
        return governance.inherited(judged, chosen, source, "observation", [F.desc("updated_at"), F.desc("id")])

    def inheritable_decisions(self, source: str, chosen: dict) -> DataFrame:
        limit = int(chosen.get("limit") or governance.INHERITED_LIMIT)
        return governance.inherited(self.decision_rows(source, limit=limit), chosen, source, "decision", [F.desc("updated_at"), F.desc("id")])

    def effective(self, project_key: str, session_id: str | None = None, now: int = 0) -> Effective:
        """Governance, worked out once for each state of the projects that it looks at."""
        if session_id is not None:
            self.session(project_key, session_id)
        made = lambda: Effective(self, project_key, session_id, now)
        return self._kept.get(("effective", project_key, session_id, now), project_key, made, lambda e: {source for source, *_ in e.links})

    def portfolio(self, now: int = 0) -> Portfolio:
        """Rows, decisions and states of all projects, in one plan each."""
        return Portfolio(self, now)

    def baselines(self) -> DataFrame:
        """The time that each project's changes count from."""
        return portfolio.baselines(self.store.observations(), self.store.read("context_syncs"), self.store.read("projects"))

    # -- sources

    def ingest(self, events: DataFrame, now: int | None = None, batch: str | None = None) -> None:
        """Stores events; a claim against the work that is open after a turn is logged with that turn.

        A replay completes what a failure has left out and changes nothing else. ``batch`` names the events.
        """
        self.store.ingest(events, batch, lambda turns, touched: self._check_turns(turns, touched, now))

    def _check_turns(self, turns: DataFrame, touched: list[int], now: int | None) -> None:
        """Events of the turns after which a claim stands against open work, whatever batches they came in.

        The state after a turn is that of the newest rows up to it in the order of time. Rows and turns of a project are
        numbered from a little before its first new turn, and each turn meets the stretch of rows that ends with it.
        """
        turns = turns.withColumn("turn_key", F.sha2(F.concat_ws("\u0001", *TURN), 256))
        since = turns.groupBy("project_key").agg(F.min("captured_at").alias("since"))
        rows = self.store.rows_of("observations", touched).where(F.col("type").isin(*changes.STATE_LIMITS)).join(since, "project_key")
        if not rows.where("type = 'completion_claim'").head(1):
            return
        before = changes.leading(rows.where("updated_at < since"), ["project_key"], changes.NEWEST_ROWS, F.desc("updated_at"), F.desc("id"))
        rows = rows.where("updated_at >= since").unionByName(before).withColumn("turn_key", F.lit(None).cast("string"))
        names = ["project_key", *TURN[1:], "id", "updated_at", "turn_key"]
        ends = turns.select("project_key", *TURN[1:], F.lit(None).cast("long").alias("id"), F.col("captured_at").alias("updated_at"), "turn_key")
        order = Window.partitionBy("project_key").orderBy("updated_at", *TURN[1:], F.col("turn_key").isNotNull(), "id")
        n = F.count("id").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("n")
        placed = rows.select(*names).unionByName(ends.select(*names)).select("project_key", "id", "turn_key", n)
        stretch = lambda n: F.floor((n - 1) / changes.NEWEST_ROWS)
        ends = placed.where("turn_key is not null and n > 0").select("project_key", "turn_key", F.col("n").alias("upto"))
        ends = ends.withColumn("stretch", F.explode(F.array(stretch(F.col("upto")), stretch(F.col("upto")) - 1)))
        numbers = placed.where("turn_key is null").select("project_key", "id", "n", stretch(F.col("n")).alias("stretch"))
        met = numbers.join(ends, ["project_key", "stretch"]).where((F.col("n") <= F.col("upto")) & (F.col("n") > F.col("upto") - changes.NEWEST_ROWS))
        state_rows = met.select("project_key", "id", "turn_key").join(rows.drop("turn_key", "since"), ["project_key", "id"])
        items = cut(changes.state_items(cut(changes.governed(state_rows, "turn_key")), "turn_key"))
        checked = state.completion_check(state.counts(items, state.open_work(items, "turn_key"), "turn_key")).where("closure_mismatch")
        at = F.col("captured_at") if now is None else F.lit(now).cast("long")
        found = checked.join(turns.select("turn_key", *TURN, "captured_at"), "turn_key")
        found = found.withColumns({"event_kind": F.lit("mismatch"), "passed": F.col("done"), "reasons": F.split("reasons", ","), "at": at})
        self.store.insert_or_ignore("closure_events", found, (*TURN, "event_kind"), "at", touched=touched)

    def ingest_notify(self, payloads: DataFrame, project_key: str | None = None, project_from_cwd: bool = False, files: DataFrame | None = None) -> None:
        self.ingest(notify_to_envelope(payloads, project_key, project_from_cwd, files))

    # -- retrieval

    def get(self, id: int) -> DataFrame:
        """One observation with its files in order."""
        return self.observations().where(F.col("id") == id).withColumn("files", F.array_sort(F.coalesce("files", F.array().cast("array<string>"))))

    def _allowed(self, project_key: str | None, session_id: str | None, now: int) -> DataFrame:
        """Rows that may be found: of the project or session, captured in their root, hidden by no policy or repair."""
        rows = self.retrievable(project_key, session_id)
        if project_key is None:
            return rows
        repaired = self.store.read("repairs", project_key).select("id")
        rules = self.effective(project_key, session_id, now).rules
        return governance.effects(rows, rules, now, repaired).where("not retrieval_excluded")

    def recent(self, project_key: str | None = None, limit: int = 10, session_id: str | None = None, now: int = 0) -> DataFrame:
        return retrieval.recent(self._allowed(project_key, session_id, now), max(1, min(limit, 50)))

    def search(self, query: str, project_key: str | None = None, limit: int = 10, session_id: str | None = None, now: int = 0) -> DataFrame:
        """Ranked search with scored notes, copies in one row; blank queries list what is recent.

        Word statistics are those of all projects' index. Every filter comes before the limit. Notes that were found, and
        important ones, are scored; notes whose score is nothing drop out.
        """
        limit = max(1, min(limit, 50))
        if not query.strip():
            return self.recent(project_key, limit, session_id, now)
        rows = self._allowed(project_key, session_id, now)
        parsed, ranks = search.parse(query), None
        if parsed is not None and parsed[0] is not None:
            sums = self.store.read("index_stats").agg(F.sum("rows").alias("n"), (F.sum("words") / F.sum("rows")).alias("avg_dl"))
            ranks = search.ranked(cut(search.counts_in_postings(self.store.read("postings"), parsed[1])), parsed[0], sums)
        found = retrieval.hits(rows, query, rows, ranks)
        known = rows.where("source_kind = 'manual_note'")
        asked = known.join(found.select("id"), "id", "left_semi").unionByName(notes.candidates(known, 100)).dropDuplicates(["id"])
        merged = notes.merge_scored(found, notes.score(asked, query), asked)
        order = [F.desc("score"), "priority", "rank", F.desc("updated_at"), "id"]
        return retrieval.collapsed(merged, *order).orderBy(*order).limit(limit)

    def note_create(self, raw: DataFrame, now: int) -> DataFrame:
        """Notes as observations; their projects come to be seen. Sessions that notes name must be the project's."""
        made = notes.create(raw).withColumns({"runtime": F.lit("note"), "turn_id": F.lit(None).cast("string"), "session_id": F.col("session_id").cast("string"), "updated_at": F.lit(now).cast("long"), "files": F.array().cast("array<string>")})
        strangers = made.where("session_id is not null").join(self.store.read("sessions"), ["project_key", "session_id"], "left_anti")
        if strangers.head(1):
            raise ValueError("Session not found for project")
        made = made.withColumn("id", F.xxhash64("dedupe_hash"))
        fresh = self.store.add_observations(made)
        self.store.append("projects", made.select("project_key", F.lit(None).cast("string").alias("root_path"), F.lit(now).cast("long").alias("seen_at")).distinct())
        return fresh

    def provenance(self, project_key: str, id: int | None = None) -> DataFrame:
        """Each memory's newest provenance with its project, session, turn and observation."""
        rows = self.store.latest("provenance", ("memory_kind", "memory_id"), project_key)
        rows = rows if id is None else rows.where((F.col("memory_kind") == "observation") & (F.col("memory_id") == str(id)))
        project = self.store.projects(project_key).select("project_key", F.col("name").alias("project_name"))
        about = self.store.sessions(project_key).select(*SESSION, F.col("cwd").alias("session_cwd"), "started_at")
        turns = self.store.read("turns", project_key).select(*TURN, "captured_at", "input_messages", "assistant_message", "raw_payload", "content_hash")
        seen = self.store.observations(project_key).select(F.col("id").alias("observation_id"), "type", "title", "summary", "detail")
        return rows.join(project, "project_key").join(about, list(SESSION), "left").join(turns, list(TURN), "left").join(seen, "observation_id", "left")

    # -- sessions

    def _labelled(self, project_key: str | None, rooted: bool = False) -> DataFrame:
        """Sessions with label, sub-scope, first message, turns and observations; the first five turns name them."""
        sessions = self.store.sessions(project_key).withColumn("key", F.concat_ws("\u0001", *SESSION))
        sessions = sessions.where("root_match") if rooted else sessions
        turns = self.store.read("turns", project_key).withColumn("key", F.concat_ws("\u0001", *SESSION))
        first = changes.leading(turns, ["key"], 5, "captured_at", "turn_id")
        said = first.select("key", "captured_at", "turn_id", F.posexplode("input_messages").alias("n", "text")).select("key", F.struct("captured_at", "turn_id", "n").alias("pos"), "text")
        counts = turns.groupBy("key").agg(F.count("*").alias("turns"), F.max("captured_at").alias("last_turn"))
        seen = self.store.observations(project_key).groupBy(F.concat_ws("\u0001", *SESSION).alias("key")).agg(F.count("*").alias("observations"))
        labelled = scope.label(sessions.withColumn("external_id", F.col("session_id")), said, "key")
        return labelled.join(counts, "key", "left").join(seen, "key", "left").withColumn("last_turn_at", F.coalesce("last_turn", "started_at")).fillna(0, ["turns", "observations"]).drop("key", "last_turn")

    def session_list(self, project_key: str | None = None, query: str | None = None, limit: int = 20, sub_scope_hint: str | None = None) -> DataFrame:
        found = scope.matches(self._labelled(project_key), query, sub_scope_hint)
        return found.orderBy(F.desc("last_turn_at"), F.desc("session_id")).limit(max(1, min(limit, 100)))

    def _scope_sessions(self, project_key: str) -> DataFrame:
        return local(self._labelled(project_key, True).orderBy(F.desc("last_turn_at"), F.desc("session_id")).limit(scope.LISTED_SESSIONS))

    def turn_list(self, project_key: str, session_id: str, limit: int = 50) -> DataFrame:
        """A session's turns, newest first, with a preview of the reply and how many observations they gave."""
        self.session(project_key, session_id)
        turns = self.store.read("turns", project_key).where(F.col("session_id") == session_id)
        seen = self.store.observations(project_key).groupBy(*TURN).agg(F.count("*").alias("observations"))
        preview = F.substring(F.replace("assistant_message", F.lit("\n"), F.lit(" ")), 1, 180).alias("preview")
        return turns.join(seen, list(TURN), "left").fillna(0, ["observations"]).select(*TURN, "captured_at", preview, "observations").orderBy(F.desc("captured_at"), F.desc("turn_id")).limit(limit)

    def recent_turns(self, project_key: str, limit: int = 8, session_id: str | None = None) -> DataFrame:
        turns = self.store.read("turns", project_key)
        if session_id is not None:
            turns = turns.where(F.col("session_id") == self.session(project_key, session_id))
        else:
            turns = turns.join(self.store.sessions(project_key).where("not root_match").select(*SESSION), list(SESSION), "left_anti")
        return turns.orderBy(F.desc("captured_at"), F.desc("turn_id")).limit(limit)

    def scope_resolve(self, project_key: str, hint: str | None = None, current_cwd: str | None = None, repo_path: str | None = None, files: tuple[str, ...] = (), limit: int = 8) -> DataFrame:
        return scope.resolve(self._scope_sessions(project_key), hint, current_cwd, repo_path, files, max(1, min(limit, 20)))

    def scope_routing(self, project_key: str, hint: str | None = None, current_cwd: str | None = None, repo_path: str | None = None, files: tuple[str, ...] = (), limit: int = 8) -> dict:
        """Where hints lead: candidates, lanes and what to do next; no session is picked without being asked for."""
        sessions = self._scope_sessions(project_key)
        found = scope.resolve(sessions, hint, current_cwd, repo_path, files, max(1, min(limit, 20)))
        rows = [r.asDict() for r in found.collect()]  # 20 at most
        places = sessions.select("session_id", "sub_scope", "cwd")
        listed = scope.lanes(found.drop("lane").join(places, "session_id") if rows else sessions.withColumn("score", F.lit(0)), limit)
        hinted = any(v and v.strip() for v in (hint, current_cwd, repo_path, *files))
        return scope.routing(hinted, rows, [r.asDict() for r in listed.collect()], sessions.count())

    def bootstrap_context(self, project_key: str, hint: str | None = None, current_cwd: str | None = None, repo_path: str | None = None, files: tuple[str, ...] = (), session_id: str | None = None, budget: str = "micro", now: int = 0) -> dict:
        """A named session's pack, or where the hints lead; the project's pack only if it isn't a container of several sessions."""
        if session_id is not None:
            made = self.context_pack(project_key, budget=budget, session_id=session_id, now=now)
            return {"project_key": project_key, "selection_mode": "explicit_session_id", "session_id": session_id, "scope_resolution": None, "context_pack": made}
        found = self.scope_routing(project_key, hint, current_cwd, repo_path, files)
        out = {"project_key": project_key, "session_id": None, "scope_resolution": found}
        if found["do_not_fetch_project_wide_pack"]:
            lane = found["routing_decision"] == "lane_resolved"
            return out | {"selection_mode": "lane_needs_session_selection" if lane else "needs_narrowing", "context_pack": None}
        return out | {"selection_mode": "project_wide", "context_pack": self.context_pack(project_key, budget=budget, now=now)}

    def scope_metadata(self, project_key: str, session_id: str | None, texts: list[str], captured: list[tuple[int, str, bool]]) -> dict:
        """Which sessions a pack is made of. texts: of its sources; captured: (time, raw time, whether it is noise) of its sources."""
        sessions = self._scope_sessions(project_key) if session_id is None else local(self._labelled(project_key).where(F.col("session_id") == session_id).limit(scope.LISTED_SESSIONS))
        rows = sessions.select("session_id", "cwd", "sub_scope", "candidates", "display_label", "last_turn_at", "turns", "observations", "producer_version").collect()  # 100 at most
        lanes = [r.asDict() for r in scope.lanes(sessions.withColumn("score", F.lit(0)), 8).collect()]
        named = scope.infer_sub_scope(self.spark.createDataFrame([(1, None, "\n".join(texts))], "key int, cwd string, text string"), "key").first()
        names = sorted({r.sub_scope for r in rows if r.sub_scope} | ({named.sub_scope} if named else set()))
        broad = session_id is None and (len(rows) > 1 or len(lanes) > 1 or len(names) > 1)
        last = max(((t, raw) for t, raw, _ in captured), default=(0, None))[1]
        operational = max(((t, raw) for t, raw, noise in captured if not noise), default=(0, None))[1]
        return {
            "scope_mode": "project" if session_id is None else "session", "session_filter_applied": session_id is not None, "source_session_count": len(rows), "source_sessions": [r.session_id for r in rows][:6],
            "source_sessions_truncated": len(rows) > 6, "source_sub_scope_count": len(names), "source_sub_scopes": names[:8], "candidate_lanes": lanes, "candidate_sub_scopes": [x["lane"] for x in lanes],
            "multiple_sessions_detected": session_id is None and len(rows) > 1, "multiple_lanes_detected": len(lanes) > 1, "broad_scope_detected": broad, "do_not_fetch_project_wide_pack": broad,
            "scope_warning": "multi_session_project_scope" if broad else None, "active_objective_suppressed": broad, "last_captured_turn_at": last, "last_operational_capture_at": operational,
            "memory_freshness": "unknown" if last is None else "persisted", "live_turn_awareness": False,
        }

    # -- state

    def _state(self, project_key: str, session_id: str | None, now: int = 0) -> tuple[DataFrame, DataFrame]:
        return self.effective(project_key, session_id, now).state()

    @staticmethod
    def _named(rows: DataFrame, project_key: str) -> DataFrame:
        return rows.withColumn("key", F.lit(project_key)).withColumnRenamed("key", "project_key")

    def operational_state(self, project_key: str, session_id: str | None = None, now: int = 0) -> DataFrame:
        """The items of the state in order, with whether they are open."""
        items, left = self._state(project_key, session_id, now)
        marked = items.join(left.select("type", "pos", F.lit(True).alias("open")), ["type", "pos"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
        return self._named(marked, project_key).orderBy("type", "pos")

    def open_work(self, project_key: str, session_id: str | None = None, now: int = 0) -> DataFrame:
        return self._named(self._state(project_key, session_id, now)[1], project_key)

    def completion_check(self, project_key: str, session_id: str | None = None, now: int = 0, record: bool = False) -> DataFrame:
        """One row, logged if asked; a project without state is open for want of evidence."""
        items, left = self._state(project_key, session_id, now)
        one = self.spark.createDataFrame([(1,)], "key int")
        counted = one.join(state.counts(items, left, "key"), "key", "left").fillna(0)
        checked = self._named(state.completion_check(counted), project_key)
        if record:
            event = {"turn_id": F.lit(None).cast("string"), "runtime": F.lit(None).cast("string"), "session_id": F.lit(session_id).cast("string"), "event_kind": F.lit("check"), "passed": F.col("done"), "reasons": F.filter(F.split("reasons", ","), lambda r: r != ""), "at": F.lit(now).cast("long")}
            self.store.append("closure_events", checked.withColumns(event))
        return checked

    def closure_metrics(self, project_key: str) -> DataFrame:
        return metrics.closure_metrics(self.store.read("closure_events", project_key))

    def scope_guard(self, project_key: str, session_id: str | None = None, now: int = 0) -> DataFrame:
        """What a pack must keep, why the work is not closed, and how broad the scope is."""
        items, left = self._state(project_key, session_id, now)
        guard = self._named(state.scope_guard(items, left, "key"), project_key)
        if session_id is not None:
            return guard.withColumns({"scope_mode": F.lit("session"), "source_session_count": F.lit(1), "broad_scope_detected": F.lit(False), "candidate_sub_scopes": F.array().cast("array<string>")})
        sessions = self._scope_sessions(project_key)
        names = [r.lane for r in scope.lanes(sessions.withColumn("score", F.lit(0)), 8).collect()]
        n = sessions.count()
        return guard.withColumns({"scope_mode": F.lit("project"), "source_session_count": F.lit(n), "broad_scope_detected": F.lit(n > 1 or len(names) > 1), "candidate_sub_scopes": F.array(*map(F.lit, names)).cast("array<string>")})

    def baseline(self, project_key: str) -> tuple[int | None, str]:
        """The time that changes count from: the sync before the latest change, else the one before the last, else the last, else none."""
        latest = self.store.observations(project_key).where(F.col("type").isin(*MEANINGFUL)).agg(F.max("updated_at")).first()[0]
        syncs = self.store.read("context_syncs", project_key).where("not skipped")
        before = syncs.where(F.col("at") < latest).agg(F.max("at")).first()[0] if latest is not None else None
        if before is not None:
            return before, "sync_before_latest_meaningful_change"
        last = [r.at for r in syncs.orderBy(F.desc("at")).limit(2).select("at").collect()]
        return (last[-1], "previous_successful_context_sync" if len(last) == 2 else "last_successful_context_sync") if last else (None, "project_start")

    def recent_changes(self, project_key: str, since: int | None = None, session_id: str | None = None, now: int = 0) -> DataFrame:
        """Open items and constraints that came and went, the objective if it changed, and new decisions, each with the baseline."""
        at, source = (since, "explicit_since") if since is not None else self.baseline(project_key)
        items, left = self._state(project_key, session_id, now)
        rows = self.retrievable(project_key, session_id).withColumn("key", F.lit(1))
        old = local(changes.state_items(changes.earlier(rows.where(F.lit(at is not None)), "key", at or 0), "key"))
        old_left = local(state.open_work(old, "key"))
        found = changes.delta(changes.watched(items, left, "key"), changes.watched(old, old_left, "key"), "key")
        now_, then = state.objective(items, "key"), state.objective(old, "key")
        changed = changes.objective_changed(now_, then, "key").where("changed").join(now_, "key", "left")
        none = F.lit(None).cast("long").alias("id")
        extra = changed.select("key", F.lit("objective").alias("part"), F.lit("changed").alias("change"), none, F.col("objective").alias("summary"))
        decided = self.decision_rows(project_key, session_id, 10).where(F.lit(at is None) | (F.col("updated_at") > (at or 0)))
        extra = extra.unionByName(decided.select(F.lit(1).alias("key"), F.lit("decision").alias("part"), F.lit("added").alias("change"), "id", "summary"))
        return self._named(found.unionByName(extra), project_key).withColumns({"since": F.lit(at).cast("long"), "baseline_source": F.lit(source)})

    def project_brief(self, project_key: str, session_id: str | None = None, now: int = 0) -> dict:
        """The project's row and counts beside what all its reports say."""
        rows = lambda frame, limit=100: [r.asDict(True) for r in frame.limit(limit).collect()]
        project = self.store.projects(project_key).first()
        if project is None:
            raise ValueError("Project not found")
        found = self.effective(project_key, session_id, now)
        counts = {"sessions": self.store.read("sessions", project_key).select(*SESSION).distinct().count(), "turns": self.store.read("turns", project_key).count(), "observations": self.store.observations(project_key).count(), "active_decisions": self.store.decisions(project_key).where("status = 'active'").count()}
        return {
            "project": project.asDict(), "counts": counts, "recent_observations": rows(self.recent(project_key, 5, session_id, now)), "recent_decisions": rows(found.decisions().orderBy("pos").select("item_key", "title", F.col("summary").alias("decision_text"), "inherited_from"), 5),
            "operational_state": rows(self.operational_state(project_key, session_id, now)), "open_work": rows(self.open_work(project_key, session_id, now)), "completion_check": rows(self.completion_check(project_key, session_id, now))[0],
            "recent_changes": rows(self.recent_changes(project_key, session_id=session_id, now=now)), "scope_guard": rows(self.scope_guard(project_key, session_id, now)), "context_metrics": rows(metrics.sync_summary(self.store.read("context_syncs", project_key)))[0],
            "closure_metrics": rows(self.closure_metrics(project_key))[0], "health_preview": self.health(project_key, now), "latest_health": rows(self.store.read("health_reports", project_key).orderBy(F.desc("at")), 1), "snapshots": rows(self.snapshot_list(project_key), 5),
            "policies": found.policies, "effective_policies": found.rules, "inheritances": found.links, "repairs": rows(self.store.read("repairs", project_key).orderBy(F.desc("at")), 10), "excluded_from_pack": len(found.hidden("pack_excluded")),
        }

    def context_pack(self, project_key: str, max_chars: int | None = None, budget: str = "auto", session_id: str | None = None, now: int = 0, known_hash: str | None = None) -> dict:
        """The pack's text, what it was made of, and a hash that only its content changes; made once for each state of the store."""
        sources = lambda _: {source for source, *_ in self.links(project_key)}
        make = lambda: self._pack(project_key, max_chars, budget, session_id, now)
        made = self._kept.get(("pack", project_key, session_id, now, max_chars, budget), project_key, make, sources)
        if known_hash == made["pack_hash"]:
            return {"not_modified": True, "pack_hash": known_hash, "message": "continuity pack unchanged"}
        return dict(made)

    def _pack(self, project_key: str, max_chars: int | None, budget: str, session_id: str | None, now: int) -> dict:
        found = self.effective(project_key, session_id, now)
        rows, cut = pack.candidates(found.rows("pack_excluded").where(F.col("pos") <= (pack.POOL if session_id is None else pack.SESSION_POOL)), "key", "session_id" if session_id is None else None)
        rows = local(rows)
        kept = found.decisions("pack_excluded").where(F.col("pos") <= pack.PACK_DECISIONS)
        newest = self.recent(project_key, pack.RECENT_ROWS, session_id, now).where("type = 'session_summary'")
        repaired = self.store.read("repairs", project_key).select("id")
        summaries = governance.effects(newest, found.rules, now, repaired).where("not pack_excluded").select("summary", "updated_at", "id").collect()  # 12 at most
        turns = self.recent_turns(project_key, max(len(summaries), pack.LEAST_TURNS), session_id).select("input_messages", "assistant_message", "timestamp", "captured_at").collect()  # 12 at most
        said = [" ".join([*(t.input_messages or ()), t.assistant_message or ""]) for t in turns]
        noise = lambda text: not text.strip() or any(p in " ".join(text.lower().split()) for p in scope.PROMPT_NOISE)
        sources = rows.select("summary", "detail", "title").collect() + kept.select("summary", "detail", "title").collect()  # 168 at most
        captured = [(t.captured_at, t.timestamp, noise(x)) for t, x in zip(turns, said, strict=True) if t.timestamp]
        about = self.scope_metadata(project_key, session_id, [" ".join(filter(None, s)) for s in sources] + said, captured)
        lines = scope.notices(about)
        lines = scope.short_notices(lines) if max_chars is not None and max_chars <= 600 else lines
        frame = lambda values, schema: self.spark.createDataFrame(values, schema)
        scopes = frame([(1, project_key, budget, max_chars, lines, about["active_objective_suppressed"])], "key int, name string, budget string, max_chars int, notices array<string>, suppressed boolean")
        made = pack.build(rows, kept.select("key", F.col("pos").alias("place"), F.col("summary").alias("value")), frame([(1, k, s.summary) for k, s in enumerate(summaries)], "key int, place int, value string"), scopes, "key", found.rows().where(F.col("pos") <= changes.STATE_ROWS))
        chars = sum(len(m or "") for t in turns for m in t.input_messages or ()) + sum(len(t.assistant_message or "") for t in turns)
        out = pack.with_source(made, frame([(1, chars)], "key int, source_chars long"), "key").drop("key").first().asDict()
        hidden, links = len(found.hidden("pack_excluded")), len(found.links)
        more = [f"- Policy-governed selection excluded {hidden} item(s) from this pack."] * bool(hidden) + [f"- Active inheritance links contributing to continuity: {links}."] * bool(links)
        if more:
            out["text"] = "\n".join([out["text"], "", "### Selection rules", *more])
            size = len(out["text"])
            out |= {"pack_chars": size, "pack_tokens": max(1, -(-size // 4)), "compression_ratio": round(size / max(out["source_chars"], 1), 3)}
        out |= about | {"project_key": project_key, "session_id": session_id, "sessions_capped": [r.asDict() for r in cut.drop("key").collect()]}
        out["pack_hash"] = hashlib.sha256(json.dumps(out, sort_keys=True, default=str).encode()).hexdigest()
        return out

    def _log_sync(self, project_key: str, made: dict, path: str | None, skipped: bool, reason: str | None, now: int) -> None:
        row = (project_key, path, skipped, reason, made["source_chars"], made["pack_chars"], made["source_tokens"], made["pack_tokens"], made["compression_ratio"], made["budget"], made["budget_reason"], 0.0, now)
        names = ("project_key", "target_path", "skipped", "reason", "source_char_count", "pack_char_count", "source_tokens", "pack_tokens", "compression_ratio", "budget", "budget_reason", "build_ms", "at")
        kinds = "project_key string, target_path string, skipped boolean, reason string, source_char_count long, pack_char_count long, source_tokens long, pack_tokens long, compression_ratio double, budget string, budget_reason string, build_ms double, at long"
        self.store.append("context_syncs", self.spark.createDataFrame([row], kinds).select(*names))
        self._source_of("context_sync", uuid.uuid4().hex, project_key, None, {"target_path": path, "skipped": skipped, "reason": reason}, now)

    def _source_of(self, kind: str, memory_id: str, project_key: str, session_id: str | None, span: dict, now: int, named: bool = True) -> None:
        """Provenance of what the engine itself made: the newest turn of the session or, if ``named``, of the project."""
        turns = self.store.read("turns", project_key)
        turns = turns if session_id is None else turns.where(F.col("session_id") == session_id)
        turn = turns.orderBy(F.desc("captured_at"), F.desc("turn_id")).first() if named or session_id is not None else None
        row = (kind, memory_id, project_key, turn.runtime if turn else None, turn.session_id if turn else session_id, turn.turn_id if turn else None, turn.content_hash if turn else None, turn.cwd if turn else None, json.dumps(span, sort_keys=True), now)
        schema = "memory_kind string, memory_id string, project_key string, runtime string, session_id string, turn_id string, turn_hash string, cwd string, source_span string, at long"
        rows = self.spark.createDataFrame([row], schema).withColumns({"observation_id": F.lit(None).cast("long"), "model_name": F.lit(None).cast("string")})
        self.store.append("provenance", rows)

    def sync_document(self, project_key: str, document: str, now: int, max_chars: int | None = None, budget: str = "auto", path: str | None = None) -> str:
        """The document with the pack in its marked part; unchanged if the pack is no smaller than its source. Both are logged."""
        made = self.context_pack(project_key, max_chars, budget, now=now)
        skipped = made["pack_tokens"] >= made["source_tokens"]
        self._log_sync(project_key, made, None if skipped else path, skipped, NOT_SMALLER if skipped else None, now)
        return document if skipped else managed_block(document, block_text(made))

    def sync_folder(self, project_key: str, folder: str, now: int, max_chars: int | None = None, budget: str = "auto") -> str | None:
        """The same for the document of a folder of any file system: the override if there is one, else the plain one."""
        hadoop, conf = self.spark._jvm.org.apache.hadoop, self.spark._jsc.hadoopConfiguration()
        at = lambda name: hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        files = at(DOCUMENTS[1]).getFileSystem(conf)
        name = DOCUMENTS[0] if files.exists(at(DOCUMENTS[0])) else DOCUMENTS[1]
        old = "# AGENTS.md\n\nAdd stable repo guidance above or below the managed block.\n\n"
        if files.exists(at(name)):
            old = "\n".join(r.value for r in self.spark.read.text(at(name).toString(), wholetext=True).collect())  # one document
        new = self.sync_document(project_key, old, now, max_chars, budget, at(name).toString())
        if new == old:
            return None
        out = files.create(at(name), True)
        out.write(bytearray(new.encode()))
        out.close()
        return at(name).toString()

    def context_metrics(self, project_key: str) -> DataFrame:
        return metrics.sync_summary(self.store.read("context_syncs", project_key))

    def health(self, project_key: str, now: int, record: bool = False) -> dict:
        """The health report: copies, contradictions, stale items, gaps, the score and what to do."""
        found = self.effective(project_key, None, now)
        items, left = found.state()
        checked = state.completion_check(state.counts(items, left, "key"))
        rows = lambda frame: [r.asDict() for r in frame.drop("key").collect()]  # noqa: E731 - of at most 240 rows
        copies = rows(changes.duplicates(found.rows(), "key"))
        against, old = rows(changes.contradictions(items, left, checked, "key")), rows(changes.stale(items, left, "key", now))
        one = checked.first()
        total, missing = (one.dod_total, one.dod_missing) if one else (0, 0)
        surplus = sum(r["n"] - 1 for r in copies)
        score = 100 - min(surplus * 4, 20) - min(len(against) * 15, 45) - min(len(old) * 3, 15) - min(missing * 8, 24)
        advice = {"dedupe_stateful_items": copies, "review_conflicting_open_and_completed_items": against, "review_stale_open_items": old, "close_definition_of_done_gaps": missing}
        report = {
            "project_key": project_key, "score": max(0, min(100, score)), "duplicate_count": surplus, "contradiction_count": len(against), "stale_item_count": len(old), "dod_total_count": total, "dod_missing_count": missing,
            "dod_coverage_ratio": 1.0 if not total else round(max(total - missing, 0) / total, 3), "open_work_count": (one.pending + one.blockers + missing) if one else 0, "closure_mismatch": bool(one and one.closure_mismatch),
            "duplicates": copies, "contradictions": against, "stale_items": old, "suggestions": [k for k, v in advice.items() if v],
        }
        if record:
            report_id = uuid.uuid4().hex
            more = json.dumps({k: report[k] for k in ("duplicates", "contradictions", "stale_items", "suggestions")}, sort_keys=True)
            kept = {k: v for k, v in report.items() if not isinstance(v, list)} | {"report_id": report_id, "details": more, "at": now}
            names = [c.split()[0] for c in TABLES["health_reports"].split(", ")]
            self.store.append("health_reports", self.spark.createDataFrame([tuple(kept[n] for n in names)], TABLES["health_reports"]))
            self._source_of("health_report", report_id, project_key, None, {"score": report["score"], "suggestions": report["suggestions"]}, now)
        return report

    def revision(self, project_key: str) -> DataFrame:
        """One row that every write about the project changes."""
        one = lambda frame, **what: frame.agg(*[w.alias(name) for name, w in what.items()])
        s = self.store
        parts = [
            one(s.read("projects", project_key), project_updated_at=F.max("seen_at")), one(s.observations(project_key), latest_observation_at=F.max("updated_at"), observations=F.count("*")), one(s.decisions(project_key), latest_decision_at=F.max("updated_at")),
            one(s.read("context_syncs", project_key), latest_sync_at=F.max("at")), one(s.read("health_reports", project_key), latest_health_at=F.max("at")), one(s.latest("policies", ("policy_id",), project_key), policies_count=F.count("*")),
            one(s.latest("inheritances", ("link_id",), project_key), inheritances_count=F.count("*")), one(s.read("repairs", project_key), repairs_count=F.count("*")),
        ]
        return reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # one row each

    # -- snapshots

    def snapshot_create(self, project_key: str, label: str, now: int, session_id: str | None = None) -> dict:
        """The whole state as JSON beside the pack; its hash holds the time, so no two are equal."""
        made = self.context_pack(project_key, budget="auto", session_id=session_id, now=now)
        rows = lambda frame: [r.asDict(True) for r in frame.collect()]  # noqa: E731 - bounded state rows
        whole = {
            "snapshot_version": 1, "project": project_key, "label": label, "created_at": now, "context_pack": made, "operational_state": rows(self.operational_state(project_key, session_id, now)), "open_work": rows(self.open_work(project_key, session_id, now)),
            "completion_check": rows(self.completion_check(project_key, session_id, now)), "recent_changes": rows(self.recent_changes(project_key, session_id=session_id, now=now)), "scope_guard": rows(self.scope_guard(project_key, session_id, now)),
            "health": self.health(project_key, now), "recent_decisions": rows(self.decision_rows(project_key, session_id, 8)), "context_metrics": rows(self.context_metrics(project_key)), "closure_metrics": rows(self.closure_metrics(project_key)),
        }
        text = json.dumps(whole, sort_keys=True, ensure_ascii=False, default=str)
        digest = hashlib.sha256(text.encode()).hexdigest()
        one = self.spark.createDataFrame([(digest, project_key, label, session_id, made["text"], text, now)], "snapshot_id string, project_key string, label string, session_id string, text string, state string, now long")
        one = one.withColumns({"slug": slug(F.col("label")), "snapshot_hash": F.col("snapshot_id"), "created_at": F.col("now"), "at": F.col("now")})
        name = F.concat_ws("__", F.date_format(F.timestamp_seconds("now"), "yyyyMMdd'T'HHmmss"), "slug", F.substring("snapshot_hash", 1, 12))
        self.store.append("snapshots", one.withColumn("path", F.concat(name, F.lit(".json"))))
        sure = "high" if session_id is not None else "low"
        self._source_of("snapshot", digest, project_key, session_id, {"label": label, "snapshot_hash": digest, "provenance_confidence": sure}, now, named=False)
        return self.snapshot_list(project_key).where(F.col("snapshot_id") == digest).first().asDict()

    def snapshot_list(self, project_key: str) -> DataFrame:
        """Snapshots, newest first, with the session and confidence of their provenance."""
        kept = self.store.latest("snapshots", ("snapshot_id",), project_key).drop("state")
        source = self.store.latest("provenance", ("memory_kind", "memory_id"), project_key).where("memory_kind = 'snapshot'")
        sure = F.get_json_object("source_span", "$.provenance_confidence").alias("provenance_confidence")
        source = source.select(F.col("memory_id").alias("snapshot_id"), "turn_id", F.col("cwd").alias("provenance_cwd"), sure)
        return kept.join(source, "snapshot_id", "left").orderBy(F.desc("created_at"), F.desc("snapshot_id"))

    def snapshot_restore(self, project_key: str, snapshot_id: str, now: int, document: str | None = None) -> dict:
        """The stored pack again, in the document if one is given; the restore is logged and no table rolls back."""
        kept = self.store.latest("snapshots", ("snapshot_id",), project_key).where(F.col("snapshot_id") == snapshot_id)
        one = kept.first()
        if one is None:
            raise ValueError("Snapshot not found")
        made = json.loads(one.state)["context_pack"]
        if not (made.get("text") or "").strip():
            raise ValueError("Snapshot does not contain a reusable context pack")
        self.store.append("snapshots", kept.withColumn("at", F.lit(now).cast("long")))
        if document is not None:
            self._log_sync(project_key, made, None, False, "snapshot_restore", now)
        return {"snapshot_id": snapshot_id, "label": one.label, "context_pack": made, "restored_at": now, "document": None if document is None else managed_block(document, block_text(made))}

    # -- governance

    def policy_list(self, project_key: str) -> DataFrame:
        return self.store.latest("policies", ("policy_id",), project_key)

    def policy_validate(self, kind: str, rule: dict) -> dict:
        return governance.validate(kind, rule)

    def policy_add(self, project_key: str, policy_id: str, kind: str, rule: dict, now: int, enabled: bool = True) -> None:
        found = governance.validate(kind, rule)
        if not found["valid"]:
            raise ValueError("; ".join(found["errors"]))
        row = (policy_id, project_key, kind, json.dumps(found["normalized_rule"], sort_keys=True), enabled, now, False)
        self.store.append("policies", self.spark.createDataFrame([row], "policy_id string, project_key string, kind string, rule string, enabled boolean, at long, deleted boolean"))

    def policy_remove(self, project_key: str, policy_id: str, now: int) -> bool:
        found = self.policy_list(project_key).where(F.col("policy_id") == policy_id)
        there = bool(found.head(1))
        if there:
            self.store.append("policies", found.withColumns({"at": F.lit(now).cast("long"), "deleted": F.lit(True)}))
        return there

    def inheritance_list(self, project_key: str) -> DataFrame:
        return self.store.latest("inheritances", ("link_id",), project_key)

    def inheritance_add(self, project_key: str, link_id: str, source_key: str, mode: str, now: int, selector: dict | None = None, enabled: bool = True) -> None:
        found = governance.validate_inheritance(mode, selector)
        if not found["valid"] or source_key == project_key:
            raise ValueError("; ".join(found["errors"]) or "a project does not inherit from itself")
        row = (link_id, project_key, source_key, mode, json.dumps(found["normalized_selector"], sort_keys=True), enabled, now, False)
        self.store.append("inheritances", self.spark.createDataFrame([row], "link_id string, project_key string, source_key string, mode string, selector string, enabled boolean, at long, deleted boolean"))

    def inheritance_remove(self, project_key: str, link_id: str, now: int) -> bool:
        found = self.inheritance_list(project_key).where(F.col("link_id") == link_id)
        there = bool(found.head(1))
        if there:
            self.store.append("inheritances", found.withColumns({"at": F.lit(now).cast("long"), "deleted": F.lit(True)}))
        return there

    def inherited(self, project_key: str, now: int = 0) -> DataFrame:
        """What links bring into the project: items and decisions under their new names."""
        found = self.effective(project_key, None, now)
        return found.all_rows.unionByName(found.all_decisions).where("inherited_from is not null and not retrieval_excluded")

    def repair_propose(self, project_key: str, now: int) -> DataFrame:
        """repair_kind, id, reason: what archiving would touch, and what only people can mend (no id)."""
        found = self.effective(project_key, None, now)
        items, left = found.state()
        checked = state.completion_check(state.counts(items, left, "key"))
        rows = found.rows().where("inherited_from is null")
        protected = found.all_rows.where("never_archive and id is not null")
        auto = changes.repairs(changes.duplicates(rows, "key"), rows, changes.stale(items, left, "key", now), "key", protected)
        review = changes.review_kinds(changes.contradictions(items, left, checked, "key"), checked, "key").withColumn("id", F.lit(None).cast("long"))
        return self._named(auto.unionByName(review), project_key)

    def repair_apply(self, project_key: str, repair_kind: str, now: int) -> int:
        """Hides what the proposal names and gives their number; rows stay in the store."""
        found = self.repair_propose(project_key, now).where((F.col("repair_kind") == repair_kind) & F.col("id").isNotNull())
        ids = [r.id for r in found.select("id").collect()]  # of 480 rows
        if not ids:
            raise ValueError("Repair proposal not found or for manual review")
        self.store.append("repairs", found.withColumn("at", F.lit(now).cast("long")))
        self._source_of("repair_event", uuid.uuid4().hex, project_key, None, {"repair_kind": repair_kind, "exclude_observation_ids": ids}, now)
        return len(ids)

    # -- processes

    def beat(self, process: str, profile: str, now: int) -> None:
        """Says that a process over this store is alive."""
        self.store.append("heartbeats", self.spark.createDataFrame([(process, "", profile, self.store.read_only, now, False)], "process string, project_key string, profile string, read_only boolean, at long, deleted boolean"))

    def health_runtime(self, now: int) -> dict:
        """How many processes were seen in the last two minutes, and whether those are too many."""
        alive = self.store.latest("heartbeats", ("process",)).where(F.col("at") >= now - ALIVE_SECONDS).count()
        return {"same_store_process_count": alive, "spawn_storm_warning": alive >= STORM}
