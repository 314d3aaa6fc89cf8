"""The continuity queries over the tables at hand, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from continuo.functions import text as T
from continuo.operators import changes, fuzzy, governance, identity, metrics, portfolio, retrieval, search, state
from continuo.plans import views
from continuo.plans.scratch import cut
from continuo.plans.views import EPOCH, PROTECTED, SQL
from continuo.sources import notify

QUERIES, ORACLES = {}, {}
POLICIES = [
    ("tag_as", {"selector": {"types": ["blocker"]}, "tags": ["urgent"]}),
    ("exclude_from_pack", {"selector": {"statuses": ["low_value"]}}),
    ("always_keep_priority", {"selector": {"tags": ["urgent"]}}),
    ("auto_archive_after", {"selector": {"types": ["decision", "blocker"]}, "days": 1}),
    ("never_archive", {"selector": {"types": ["blocker"]}}),
]
SEARCHED = "der und"
_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower({}), '\s+', ' ', 'g')), '\b(?:is )?still missing\b', ' missing', 'g'), '\bno\s+(.+?)\s+yet\b', '\1 missing', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_MEMORY = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({}), '\', '/'), '\b(?:turn|session|project|observation)_?id\s*[:=]\s*[a-z0-9_.:-]+\b', '', 'g'), '\b\d{{4}}-\d{{2}}-\d{{2}}t\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?(?:z|[+-]\d{{2}}:\d{{2}})?\b', '', 'g'), '\s+', ' ', 'g'))"
_PROTECTED = "(" + ", ".join(f"'{p}'" for p in PROTECTED) + ")"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = SQL + sql
        return f

    return register


@query("SELECT id, project_key, session_id, type, title, status, importance, updated_at FROM observations ORDER BY updated_at DESC, id DESC LIMIT 50")
def recent_observations(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.recent(views.observations(spark, sf)).select("id", "project_key", "session_id", "type", "title", "status", "importance", "updated_at")


@query("SELECT project_key, count(DISTINCT session_id) AS sessions, count(*) AS observations, count(*) FILTER (type = 'decision' AND status = 'active') AS active_decisions, max(updated_at) AS updated_at FROM observations GROUP BY 1")
def project_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.project_rollup(views.observations(spark, sf))


@query("SELECT t.session_id, t.turns, t.last_at, t.first_text, coalesce(o.n, 0) AS observations FROM (SELECT session_id, count(*) AS turns, max(captured_at) AS last_at, arg_min(text, captured_at) AS first_text FROM turns GROUP BY 1) t LEFT JOIN (SELECT session_id, count(*) AS n FROM observations GROUP BY 1) o ON o.session_id = t.session_id")
def session_list(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.session_list(views.turns(spark, sf), views.observations(spark, sf, status=False))


@query("SELECT session_id, turn, role, substr(replace(text, chr(10), ' '), 1, 180) AS preview, captured_at FROM turns")
def turn_list(spark: SparkSession, sf: str) -> DataFrame:
    return views.turns(spark, sf).select("session_id", "turn", "role", F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 180).alias("preview"), "captured_at")


@query("SELECT count(*) AS events, sum(skipped::INT)::BIGINT AS skipped, round(avg(compression_ratio), 3) AS ratio, round(avg(build_ms), 3) AS build_ms, max(generated_at) AS latest FROM sync")
def sync_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.sync_metrics(views.sync_events(spark, sf))


@query("SELECT budget, count(*) AS events, round(avg(compression_ratio), 3) AS ratio FROM sync GROUP BY 1")
def sync_by_budget(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.sync_by_budget(views.sync_events(spark, sf))


@query("SELECT budget, reason, count(*) AS n FROM (SELECT budget, unnest([x FOR x IN [CASE WHEN k & 1 > 0 THEN 'pending_items_open' END, CASE WHEN k & 2 > 0 THEN 'blockers_open' END, CASE WHEN k & 4 > 0 THEN 'dod_incomplete' END, CASE WHEN k & 8 > 0 THEN 'missing_evidence' END] IF x IS NOT NULL]) AS reason FROM sync) GROUP BY 1, 2")
def closure_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.closure_reasons(views.sync_events(spark, sf))


@query("SELECT (SELECT max(updated_at) FROM observations) AS observations_at, (SELECT count(*) FROM observations) AS observations, (SELECT max(captured_at) FROM turns) AS turns_at, (SELECT count(*) FROM turns) AS turns, (SELECT max(generated_at) FROM sync) AS sync_at")
def project_revision(spark: SparkSession, sf: str) -> DataFrame:
    o = views.observations(spark, sf).agg(F.max("updated_at").alias("observations_at"), F.count("*").alias("observations"))
    t = views.turns(spark, sf).agg(F.max("captured_at").alias("turns_at"), F.count("*").alias("turns"))
    return o.join(F.broadcast(t)).join(F.broadcast(views.sync_events(spark, sf).agg(F.max("generated_at").alias("sync_at"))))  # one row each


@query("SELECT project_key, max(updated_at) AS latest FROM observations WHERE type NOT IN ('user_request', 'decision', 'session_summary') GROUP BY 1")
def latest_change(spark: SparkSession, sf: str) -> DataFrame:
    return views.observations(spark, sf, status=False).where(F.col("type").isin(*views.MEANINGFUL)).groupBy("project_key").agg(F.max("updated_at").alias("latest"))


@query(f"SELECT type, normalized, count(*) AS n, min(id) AS first_id, max(id) AS last_id, arg_max(summary, (updated_at, id)) AS latest_summary FROM (SELECT type, id, summary, updated_at, {_NORMAL.format('summary')} AS normalized FROM observations) WHERE normalized <> '' GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.duplicate_buckets(views.observations(spark, sf, status=False))


@query(f"SELECT max(id) AS id, fingerprint, count(*) AS duplicate_count, count(DISTINCT session_id) AS sessions, max(updated_at) AS latest FROM (SELECT *, sha256({_MEMORY.format('''concat_ws(chr(0), type, status, concat_ws(' ', summary, detail, title))''')}) AS fingerprint FROM observations) GROUP BY fingerprint")
def retrieval_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.dedupe(views.observations(spark, sf))


@query(f"SELECT id, session_id, type FROM observations QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN type IN {_PROTECTED} THEN 0 ELSE 1 END, updated_at DESC, id DESC) <= 8")
def session_cap(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.cap_per_session(views.observations(spark, sf, status=False)).select("id", "session_id", "type")


@query("SELECT id, project_key, row_number() OVER (PARTITION BY project_key ORDER BY CASE WHEN importance >= 4 THEN 0 ELSE 1 END, updated_at, id::VARCHAR)::INT AS pos FROM observations")
def priority_sort(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.priority_positions(views.observations(spark, sf, status=False)).select("id", "project_key", "pos")


@query("SELECT id, project_key FROM observations WHERE lower(title) LIKE '%der %' OR lower(summary) LIKE '%der %' OR lower(detail) LIKE '%der %'")
def like_search(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.like_search(views.observations(spark, sf, status=False), "der ").select("id", "project_key")


_BM25 = r""", w AS (SELECT id, regexp_extract_all(lower(concat_ws(' ', title, summary, detail)), '[\p{L}\p{N}]+') AS words FROM observations),
f AS (SELECT id, len(words) AS dl, len([x FOR x IN words IF x = 'der']) AS f0, len([x FOR x IN words IF x = 'und']) AS f1 FROM w),
s AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM f),
ranked AS (SELECT id, 0 - greatest(ln((n - n0 + 0.5::DOUBLE) / (n0 + 0.5::DOUBLE)), 1e-6::DOUBLE) * f0 * 2.2::DOUBLE / (f0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a)) - greatest(ln((n - n1 + 0.5::DOUBLE) / (n1 + 0.5::DOUBLE)), 1e-6::DOUBLE) * f1 * 2.2::DOUBLE / (f1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a)) AS rank FROM f, s WHERE f0 > 0 AND f1 > 0)
"""


@query(_BM25 + "SELECT id, round(rank, 6) AS rank FROM ranked")
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bm25(views.observations(spark, sf, status=False), SEARCHED).select("id", F.round("rank", 6).alias("rank"))


@query(_BM25 + "SELECT id, type FROM observations JOIN ranked USING (id) ORDER BY priority, round(rank, 9), updated_at DESC LIMIT 20")
def ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.search(views.observations(spark, sf, status=False), SEARCHED, 20).select("id", "type")


_COPY = _MEMORY.format("""concat_ws(chr(0), type, status, concat_ws(' ', nullif(summary, ''), nullif(detail, ''), nullif(title, '')))""")


@query(_BM25 + f""", m AS (SELECT *, sha256({_COPY}) AS fingerprint FROM observations JOIN ranked USING (id) WHERE project_key IN ('src1', 'src3'))
SELECT id, type, duplicate_count, sessions, latest FROM (SELECT *, count(*) OVER f AS duplicate_count, max(updated_at) OVER f AS latest, row_number() OVER (PARTITION BY fingerprint ORDER BY priority, round(rank, 9), updated_at DESC, id) AS k FROM m WINDOW f AS (PARTITION BY fingerprint))
JOIN (SELECT fingerprint, count(DISTINCT session_id) AS sessions FROM m GROUP BY 1) USING (fingerprint) WHERE k = 1 ORDER BY priority, round(rank, 9), updated_at DESC, id LIMIT 20""")
def search_full(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked over all rows, found among two projects, copies in one row, then the limit."""
    rows = views.observations(spark, sf)
    among = rows.where(F.col("project_key").isin("src1", "src3"))
    order = ["priority", F.round("rank", 9), F.desc("updated_at"), "id"]
    found = retrieval.collapsed(retrieval.hits(rows, SEARCHED, among), *order)
    return found.orderBy(*order).limit(20).select("id", "type", "duplicate_count", "sessions", "latest")


_LANGUAGE = r"""SELECT id, (len([x FOR x IN regexp_extract_all(lower(title), '[\p{L}\p{N}]+') IF x = 'und']) + len([x FOR x IN regexp_extract_all(lower(detail), '[\p{L}\p{N}]+') IF x = 'und']) + len([x FOR x IN regexp_extract_all(lower(summary), '[\p{L}\p{N}]+') IF x = 'und'])) > 0 AS u,
 len([x FOR x IN regexp_extract_all(lower(title), '[\p{L}\p{N}]+') IF starts_with(x, 'th')]) > 0 AS p,
 ' ' || array_to_string(regexp_extract_all(lower(detail), '[\p{L}\p{N}]+'), ' ') || ' ' || ' . ' || array_to_string(regexp_extract_all(lower(summary), '[\p{L}\p{N}]+'), ' ') || ' . ' || array_to_string(regexp_extract_all(lower(title), '[\p{L}\p{N}]+'), ' ') || ' ' AS w FROM observations"""


@query(f", l AS ({_LANGUAGE}) SELECT id FROM l WHERE (p OR contains(w, ' of the ')) AND NOT u")
def search_language(spark: SparkSession, sf: str) -> DataFrame:
    """A prefix in one column, a phrase in any, and a word that must not occur."""
    return retrieval.bm25(views.observations(spark, sf, status=False), '(title : th* OR "of the") NOT und').select("id")


_NEAR = "NEAR(und der, 2) OR ^the"
_PLACES = r""", c AS (SELECT id, 1 AS c, regexp_extract_all(lower(title), '[\p{L}\p{N}]+') AS words FROM observations
    UNION ALL SELECT id, 2, regexp_extract_all(lower(summary), '[\p{L}\p{N}]+') FROM observations UNION ALL SELECT id, 3, regexp_extract_all(lower(detail), '[\p{L}\p{N}]+') FROM observations),
p AS (SELECT id, c, unnest(words) AS word, unnest(range(len(words))) AS pos FROM c),
near AS (SELECT u.id, count(DISTINCT (u.c, u.pos)) AS f0, count(DISTINCT (d.c, d.pos)) AS f1 FROM p u JOIN p d ON d.id = u.id AND d.c = u.c AND abs(d.pos - u.pos) <= 3
    WHERE u.word = 'und' AND d.word = 'der' GROUP BY u.id),
first AS (SELECT id, count(*) AS f2 FROM p WHERE word = 'the' AND pos = 0 GROUP BY id),
l AS (SELECT id, sum(len(words))::BIGINT AS dl FROM c GROUP BY id),
s AS (SELECT count(*) AS n, avg(dl) AS a, (SELECT count(DISTINCT id) FROM p WHERE word = 'und') AS n0, (SELECT count(DISTINCT id) FROM p WHERE word = 'der') AS n1, (SELECT count(*) FROM first) AS n2 FROM l),
h AS (SELECT l.*, s.*, coalesce(f0, 0) AS f0, coalesce(f1, 0) AS f1, coalesce(f2, 0) AS f2 FROM l LEFT JOIN near USING (id) LEFT JOIN first USING (id), s WHERE f0 > 0 OR f2 > 0)
"""
_WORTH = "greatest(ln((n - n{0} + 0.5::DOUBLE) / (n{0} + 0.5::DOUBLE)), 1e-6::DOUBLE) * f{0} * 2.2::DOUBLE / (f{0} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))"


@query(_PLACES + f"SELECT id, round(0 - {' - '.join(_WORTH.format(k) for k in range(3))}, 6) AS rank FROM h")
def search_near(spark: SparkSession, sf: str) -> DataFrame:
    """Two words near each other, or one that begins a column, by the inverted index of all observations."""
    rows = views.observations(spark, sf, status=False)
    tree, phrases = search.parse(_NEAR)
    sums = search.lengths(rows).agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))
    found = search.ranked(cut(search.counts_in_postings(search.posting_rows(rows), phrases)), tree, sums)
    return found.select("id", F.round("rank", 6).alias("rank"))


@query("SELECT project_key, session_id, count(*) AS items, max(updated_at) AS latest, max(importance) AS top FROM observations GROUP BY 1, 2")
def lane_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return views.observations(spark, sf, status=False).groupBy("project_key", "session_id").agg(F.count("*").alias("items"), F.max("updated_at").alias("latest"), F.max("importance").alias("top"))


@query("SELECT o.id, o.project_key, t.turns, t.last_at FROM observations o LEFT JOIN (SELECT session_id, count(*) AS turns, max(captured_at) AS last_at FROM turns GROUP BY 1) t USING (session_id)")
def provenance_star(spark: SparkSession, sf: str) -> DataFrame:
    by_session = views.turns(spark, sf).groupBy("session_id").agg(F.count("*").alias("turns"), F.max("captured_at").alias("last_at"))
    return views.observations(spark, sf, status=False).join(by_session, "session_id", "left").select("id", "project_key", "turns", "last_at")


@query("SELECT project_id, arg_max(event_id, (generated_at, event_id)) AS event_id, max(generated_at) AS generated_at FROM sync WHERE NOT skipped GROUP BY 1")
def latest_one(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.latest_sync(views.sync_events(spark, sf))


@query("SELECT s.project_id, c.changed_at, arg_max(s.event_id, (s.generated_at, s.event_id)) AS event_id FROM sync s JOIN (SELECT project_id, max(generated_at) AS changed_at FROM sync WHERE k >= 50 GROUP BY 1) c ON c.project_id = s.project_id WHERE NOT s.skipped AND s.generated_at < c.changed_at GROUP BY 1, 2")
def baseline_asof(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.baseline_sync(views.sync_events(spark, sf))


_ARCHIVED = f"(type = 'decision' AND updated_at <= {EPOCH + 500})"


@query(f"SELECT id, CASE WHEN type = 'blocker' THEN 'urgent' ELSE '' END AS tags, {_ARCHIVED} AS retrieval_excluded, {_ARCHIVED} OR status = 'low_value' AS pack_excluded, type = 'blocker' AND status <> 'low_value' AS keep_priority, type = 'blocker' AS never_archive FROM observations")
def policy_effects(spark: SparkSession, sf: str) -> DataFrame:
    out = governance.effects(views.observations(spark, sf), POLICIES, EPOCH + 500 + 86_400)
    return out.select("id", F.array_join("tags", ",").alias("tags"), "retrieval_excluded", "pack_excluded", "keep_priority", "never_archive")


@query("SELECT l.t AS target, l.s AS source, 'inh-observation:' || l.s || ':' || id AS item_key, type, title || ' (inherited from ' || l.s || ')' AS title FROM observations o JOIN (VALUES ('src1', 'src0', 'blocker,decision', 8), ('src2', 'src0', NULL, 3), ('src1', 'src3', NULL, 8)) l(t, s, k, n) ON o.project_key = l.s AND (l.k IS NULL OR contains(l.k, o.type)) QUALIFY row_number() OVER (PARTITION BY l.t, l.s ORDER BY updated_at DESC, id DESC) <= l.n")
def inherited_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.observations(spark, sf, status=False).withColumn("tags", F.array().cast("array<string>")).withColumn("status", F.lit("active"))
    links = (("src1", "src0", {"types": ["blocker", "decision"]}), ("src2", "src0", {"limit": 3}), ("src1", "src3", {}))
    order = [F.desc("updated_at"), F.desc("id")]
    taken = [governance.inherited(rows.where(F.col("project_key") == source), chosen, source, "observation", order).select(F.lit(target).alias("target"), F.lit(source).alias("source"), "item_key", "type", "title") for target, source, chosen in links]
    return taken[0].unionByName(taken[1]).unionByName(taken[2])


#: Rules and links of several projects: (project, order, kind, rule), (project, order, link, source, mode, selector).
ALL_POLICIES = [
    ("src0", 1, "tag_as", '{"selector": {"types": ["session_dod", "decision", "mission_dod"]}, "tags": ["inheritable"]}'),
    ("src0", 2, "tag_as", '{"selector": {"tags": ["inheritable"], "text_contains": ["und"]}, "tags": ["twice"]}'),
    ("src0", 3, "exclude_from_pack", '{"selector": {"tags": ["twice"]}}'),
    ("src1", 1, "auto_archive_after", '{"selector": {"types": ["decision", "objective"]}, "days": 1}'),
    ("src1", 2, "never_archive", '{"selector": {"text_contains": ["der"]}}'),
    ("src2", 1, "exclude_from_pack", '{"selector": {"statuses": ["low_value"]}}'),
    ("src2", 2, "always_keep_priority", '{"selector": {"types": ["constraint"], "statuses": ["low_value", "active"]}}'),
]
ALL_LINKS = [
    ("src1", 1, "l1", "src0", "marked_inheritable", '{"tags": ["inheritable"], "limit": 3}'),
    ("src2", 1, "l2", "src1", "rules_only", "{}"),
    ("src3", 1, "l3", "src0", "combined", '{"types": ["decision"], "limit": 2}'),
]
_THEN = EPOCH + 500 + 86_400
_GOVERNED = f""", newest AS (SELECT *, lower(trim(title) || ' ' || trim(summary) || ' ' || trim(summary)) AS t FROM observations QUALIFY row_number() OVER (PARTITION BY project_key ORDER BY updated_at DESC, id DESC) <= 480),
tagged AS (SELECT *, CASE WHEN project_key = 'src0' AND type IN ('session_dod', 'decision', 'mission_dod') THEN CASE WHEN contains(t, 'und') THEN 'inheritable,twice' ELSE 'inheritable' END ELSE '' END AS tags FROM newest),
m AS (SELECT project_key, 'observation:' || id AS item_key, type, status, t, tags, updated_at, false AS passed, id FROM tagged
  UNION ALL SELECT target, 'inh-observation:src0:' || id, type, status, t, tags, updated_at, true, NULL FROM
    (SELECT 'src1' AS target, *, row_number() OVER (ORDER BY updated_at DESC, id DESC) AS k FROM tagged WHERE project_key = 'src0' AND tags <> '' UNION ALL
     SELECT 'src3', *, row_number() OVER (ORDER BY updated_at DESC, id DESC) + 1 FROM tagged WHERE project_key = 'src0' AND type = 'decision') WHERE k <= 3),
r AS (SELECT *, project_key IN ('src1', 'src2') AND type IN ('decision', 'objective') AND updated_at <= {EPOCH + 500} AS old, project_key IN ('src1', 'src2') AND contains(t, 'der') AS never,
    project_key = 'src2' AND type = 'constraint' AND status IN ('low_value', 'active') AS keep, project_key IN ('src0', 'src3') AND contains(tags, 'twice') OR project_key = 'src2' AND status = 'low_value' AS out FROM
    (SELECT * REPLACE (CASE WHEN project_key = 'src3' AND type IN ('session_dod', 'decision', 'mission_dod') AND NOT passed THEN CASE WHEN contains(t, 'und') THEN 'inheritable,twice' ELSE 'inheritable' END ELSE tags END AS tags) FROM m))
"""


@query(_GOVERNED + "SELECT project_key, item_key, type, tags, old AND NOT never AS retrieval_excluded, old AND NOT never OR out AS pack_excluded, keep AND NOT (old AND NOT never OR out) AS keep_priority, never AS never_archive FROM r")
def governance_all(spark: SparkSession, sf: str) -> DataFrame:
    """Rules, links and what they say of every project's newest rows, in one plan."""
    policies = spark.createDataFrame(ALL_POLICIES, "project_key string, n long, kind string, rule string")
    links = spark.createDataFrame(ALL_LINKS, "project_key string, n long, link_id string, source_key string, mode string, selector string")
    plain = {"item_key": F.concat(F.lit("observation:"), F.col("id").cast("string")), "inherited_from": F.lit(None).cast("string"), "tags": F.array().cast("array<string>")}
    rows = changes.leading(views.observations(spark, sf), ["project_key"], changes.NEWEST_ROWS, F.desc("updated_at"), F.desc("id")).withColumns(plain)
    sources = portfolio.effects(rows, portfolio.rules(policies), _THEN).where("not retrieval_excluded")
    passed = portfolio.inherited(sources, links, governance.OBSERVATIONS_PASS, "observation")
    names = [c for c in portfolio.NAMES if c != "session_id"]
    found = portfolio.effects(rows.select(*names).unionByName(passed.select(*names)), portfolio.rules(policies, links), _THEN)
    return found.select("project_key", "item_key", "type", F.array_join("tags", ",").alias("tags"), "retrieval_excluded", "pack_excluded", "keep_priority", "never_archive")


@query("""SELECT p.project_key, coalesce(b, CASE WHEN n > 1 THEN prev ELSE last END) AS since, CASE WHEN b IS NOT NULL THEN 'sync_before_latest_meaningful_change' WHEN n > 1 THEN 'previous_successful_context_sync'
    WHEN n = 1 THEN 'last_successful_context_sync' ELSE 'project_start' END AS source
FROM (SELECT DISTINCT project_id AS project_key FROM sync) p LEFT JOIN (SELECT s.project_id, max(generated_at) FILTER (generated_at < changed_at) AS b, count(*) AS n, max(generated_at) AS last, list(generated_at ORDER BY generated_at DESC)[2] AS prev
  FROM sync s LEFT JOIN (SELECT project_id, max(generated_at) AS changed_at FROM sync WHERE k >= 99 AND budget = 'error' GROUP BY 1) c USING (project_id) WHERE NOT skipped GROUP BY 1) x ON x.project_id = p.project_key""")
def baselines_all(spark: SparkSession, sf: str) -> DataFrame:
    """The time that changes of every project count from; failed syncs with a high key stand for changes."""
    syncs = views.sync_events(spark, sf).withColumnsRenamed({"project_id": "project_key", "generated_at": "at"})
    changed = syncs.where("k >= 99 and skipped").select("project_key", F.lit("blocker").alias("type"), F.col("at").alias("updated_at"))
    return portfolio.baselines(changed, syncs, syncs)


@query(f"SELECT id, {_NORMAL.format('detail')} AS normalized FROM observations")
def normalize_state(spark: SparkSession, sf: str) -> DataFrame:
    return views.observations(spark, sf, status=False).select("id", T.normalize_state(F.col("detail")).alias("normalized"))


@query("SELECT project_key, sum(length(detail))::BIGINT AS source_chars, sum(length(summary))::BIGINT AS pack_chars, greatest(1, ceil(sum(length(detail)) / 4.0))::BIGINT AS source_tokens, greatest(1, ceil(sum(length(summary)) / 4.0))::BIGINT AS pack_tokens FROM observations GROUP BY 1")
def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.token_stats(views.observations(spark, sf, status=False))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.first_wins(views.read(spark, sf, "events"), ["user_id", "event_type"], "event_id")


def _facts_sql() -> str:
    """Extraction in SQL. Its regular expressions look neither ahead nor back, so marks stand in: chr(2) joins the words
    of a two-word definition-of-done label, chr(1) goes before a label inside a line."""
    labels = "|".join(labels for _, labels, _, _ in state.KINDS).replace(r"\s+", chr(2))
    flat = r"regexp_replace(seg, '(?i)\b(project|mission|session)\s+(dod|definition of done)', '\1' || chr(2) || '\2', 'g')"
    marked = rf"regexp_replace({flat}, '(?i)\s+((?:decision|decisión|{labels}|status)\s*[:\-])', chr(1) || '\1', 'g')"
    cases = " ".join(f"WHEN regexp_matches(segment, '(?i)^\\s*(?:{labels})\\s*[:\\-]\\s*(.+)$') THEN {{}}".replace("{}", f"{{{k}}}") for k, (_, labels, _, _) in enumerate(state.KINDS))
    kinds = cases.format(*[f"'{kind}'" for kind, *_ in state.KINDS])
    values = cases.format(*[f"regexp_extract(segment, '(?i)^\\s*(?:{labels})\\s*[:\\-]\\s*(.+)$', 1)" for _, labels, _, _ in state.KINDS])
    claim = state.CLAIM.replace("'", "''")
    return rf""", l AS (SELECT session_id, turn, unnest(x) AS t, generate_subscripts(x, 1) AS line FROM (SELECT session_id, turn, string_split_regex(labelled, '{T.LINE_END}') AS x FROM turns)),
c AS (SELECT session_id, turn, line, unnest(x) AS seg, generate_subscripts(x, 1) AS cut FROM (SELECT *, string_split_regex(trim(t), '\s*;\s*') AS x FROM l)),
p AS (SELECT session_id, turn, line, cut, unnest(x) AS t, generate_subscripts(x, 1) AS part FROM (SELECT *, string_split({marked}, chr(1)) AS x FROM (SELECT session_id, turn, line, cut, trim(seg) AS seg FROM c))),
s AS (SELECT * EXCLUDE t, trim(replace(t, chr(2), ' ')) AS segment FROM p WHERE trim(t) <> ''),
k AS (SELECT *, CASE {kinds} WHEN regexp_matches(segment, '{claim}') THEN 'completion_claim' END AS kind, CASE {values} END AS raw FROM s),
v AS (SELECT *, regexp_replace(trim(regexp_replace(raw, '\s+', ' ', 'g')), '^[ -]+|[ -]+$', '', 'g') AS whole FROM k WHERE kind IS NOT NULL),
w AS (SELECT *, CASE WHEN kind = 'completion_claim' THEN 'assistant claimed the work was complete' WHEN regexp_matches(whole, '[.!?]\s+[A-Z]') THEN trim(regexp_extract(whole, '^(.*?[.!?])\s+[A-Z]', 1)) ELSE trim(whole) END AS value FROM v),
n AS (SELECT *, {_NORMAL.format("CASE WHEN kind = 'completion_claim' THEN segment ELSE value END")} AS normalized FROM w),
facts AS (SELECT session_id, turn, line, cut, part, kind, value, normalized FROM n WHERE normalized NOT IN ('', 'and', 'or') QUALIFY row_number() OVER (PARTITION BY session_id, turn, kind, normalized ORDER BY line, cut, part) = 1),
counted AS (SELECT session_id, count(*) FILTER (kind = 'pending_item') AS pending, count(*) FILTER (kind = 'blocker') AS blockers, count(*) FILTER (kind LIKE '%_dod') AS dod_missing, count(*) FILTER (kind = 'completed_item') AS evidence,
 count(*) FILTER (kind = 'completion_claim') AS claims, count(*) FILTER (kind = 'constraint') AS constraints, count(*) FILTER (kind = 'objective') AS objectives FROM facts GROUP BY 1)
"""


def _match(a: str, b: str) -> str:
    """The state match of two normal forms in SQL."""
    words = lambda x: f"[w FOR w IN string_split({x}, ' ') IF w <> '' AND w NOT IN {tuple(T.STATE_STOPWORDS)}]"
    inside = lambda x, y: f"len([v FOR v IN {words(x)} IF NOT list_contains({words(y)}, v)]) = 0"
    return f"({a} = {b} OR (length({a}) >= 18 AND contains({b}, {a})) OR (length({b}) >= 18 AND contains({a}, {b})) OR (len({words(a)}) > 0 AND len({words(b)}) > 0 AND ({inside(a, b)} OR {inside(b, a)})))"


def fold_sql(source: str, name: str, key: str, carried: tuple[str, ...], limit: str) -> str:
    """Greedy fuzzy dedupe in SQL: six rounds, each of which takes a kind's first text left and drops what matches it."""
    kept = ", ".join(f"arg_min({c}, pos) AS {c}" for c in carried)
    out = f", {name}_0 AS MATERIALIZED (SELECT {key}, type, normalized, min(pos) AS pos{', ' + kept if kept else ''} FROM {source} WHERE normalized <> '' GROUP BY 1, 2, 3)"
    for k in range(1, 7):
        out += f", {name}_k{k} AS MATERIALIZED (SELECT * FROM {name}_{k - 1} QUALIFY row_number() OVER (PARTITION BY {key}, type ORDER BY pos) = 1)"
        out += f", {name}_{k} AS MATERIALIZED (SELECT b.* FROM {name}_{k - 1} b JOIN {name}_k{k} a ON a.{key} = b.{key} AND a.type = b.type AND NOT {_match('a.normalized', 'b.normalized')})"
    return out + f", {name} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM {name}_k{k} WHERE {limit} >= {k}" for k in range(1, 7)) + ")"


def open_sql(items: str, name: str, key: str) -> str:
    """Open items of a state, and its counts in ``name``_counts."""
    dod = f"type IN {state.DOD}"
    return f""", {name} AS MATERIALIZED (SELECT p.* FROM {items} p WHERE p.type = 'blocker' OR ((p.type = 'pending_item' OR p.{dod}) AND NOT EXISTS (SELECT 1 FROM {items} d WHERE d.type = 'completed_item' AND d.{key} = p.{key} AND {_match('p.normalized', 'd.normalized')}))),
{name}_counts AS MATERIALIZED (SELECT i.*, coalesce(pending, 0) AS pending, coalesce(blockers, 0) AS blockers, coalesce(dod_missing, 0) AS dod_missing FROM
 (SELECT {key}, count(*) FILTER (type = 'completed_item') AS evidence, count(*) FILTER (type = 'completion_claim') AS claims, count(*) FILTER (type = 'constraint') AS constraints, count(*) FILTER (type = 'objective') AS objectives, count(*) FILTER (type = 'user_request') AS requests, count(*) FILTER ({dod}) AS dod_total FROM {items} GROUP BY 1) i
 LEFT JOIN (SELECT {key}, count(*) FILTER (type = 'pending_item') AS pending, count(*) FILTER (type = 'blocker') AS blockers, count(*) FILTER ({dod}) AS dod_missing FROM {name} GROUP BY 1) o ON o.{key} = i.{key})"""


LIMIT_SQL = "CASE type " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in changes.STATE_LIMITS.items()) + " END"
FACTS = _facts_sql()
_NEWEST = f"row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, line DESC, cut DESC, part DESC) <= {changes.NEWEST_ROWS}"
_FEW = f", few AS (SELECT * FROM (SELECT * FROM facts QUALIFY {_NEWEST}) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn, line, cut, part) <= {changes.STATE_ROWS}) "
REQUESTS = rf"""requests AS (SELECT session_id, turn, -1 AS line, substr(trim(array_to_string([x FOR x IN [trim(y) FOR y IN string_split_regex(labelled, '{T.LINE_END}')] IF x <> ''], ' | ')), 1, 280) AS value FROM turns WHERE role <> 'assistant'),
said AS (SELECT session_id, turn, line, cut, part, kind AS type, value AS summary FROM facts UNION ALL SELECT session_id, turn, line, 0, 0, 'user_request', value FROM requests WHERE value <> ''),
placed AS (SELECT *, {_NORMAL.format('summary')} AS normalized FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn, line, cut, part) AS pos FROM (SELECT * FROM said QUALIFY {_NEWEST})) WHERE pos <= {changes.STATE_ROWS})"""
_SAID = FACTS + ", " + REQUESTS + fold_sql("placed", "si", "session_id", ("summary",), LIMIT_SQL) + open_sql("si", "oi", "session_id")
_REASONS = "concat_ws(',', CASE WHEN pending > 0 THEN 'pending_items_open' END, CASE WHEN blockers > 0 THEN 'blockers_open' END, CASE WHEN dod_missing > 0 THEN 'dod_incomplete' END, CASE WHEN evidence = 0 THEN 'missing_evidence' END)"
_BUDGET = "CASE " + " ".join(f"WHEN pending <= {p} AND blockers <= {b} AND dod_missing <= {d} AND constraints <= {c} AND summaries <= {n} THEN {{{k}}}" for k, (_, p, b, d, c, n) in enumerate(state.BUDGETS)) + " ELSE {3} END"


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    return state.extract(views.turns(spark, sf), "labelled", "session_id", "turn")


def _state_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The facts that a session's state is derived from: of the newest ones the oldest, as many as the model takes."""
    return changes.leading(_newest(_extracted(spark, sf)), ["session_id"], changes.STATE_ROWS, "turn", "line", "cut", "part")


def _newest(rows: DataFrame) -> DataFrame:
    return changes.leading(rows, ["session_id"], changes.NEWEST_ROWS, *[F.desc(c) for c in ("turn", "line", "cut", "part")])


def said(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the requests of turns that people wrote, as rows of a state."""
    asked = views.turns(spark, sf).where("role <> 'assistant'").withColumn("summary", state.request(F.col("labelled"))).where("summary <> ''")
    place = {"line": F.lit(-1), "cut": F.lit(0), "part": F.lit(0), "type": F.lit("user_request")}
    names = ["session_id", "turn", *place, "summary"]
    facts = _extracted(spark, sf).withColumnsRenamed({"kind": "type", "value": "summary"}).select(*names)
    rows = _newest(facts.unionByName(asked.withColumns(place).select(*names)))
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("turn", "line", "cut", "part"))
    none = {c: F.lit("") for c in ("detail", "title")} | {"id": F.lit(0).cast("long"), "updated_at": F.lit(0).cast("long")}
    return rows.withColumn("pos", order).where(F.col("pos") <= changes.STATE_ROWS).withColumns(none)


def _counted(spark: SparkSession, sf: str) -> DataFrame:
    items = changes.state_items(said(spark, sf), "session_id")
    return state.counts(items, state.open_work(items, "session_id"), "session_id")


@query(FACTS + "SELECT session_id, turn, kind, value, normalized FROM facts")
def extract_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).select("session_id", "turn", "kind", "value", "normalized")


@query("SELECT session_id, turn, count(*) AS segments FROM (SELECT session_id, turn, unnest(string_split_regex(trim(l), '\\s*;\\s*')) AS s FROM (SELECT session_id, turn, unnest(string_split(labelled, chr(10))) AS l FROM turns)) WHERE trim(s) <> '' GROUP BY 1, 2".replace("\\\\", "\\"))
def extract_segments(spark: SparkSession, sf: str) -> DataFrame:
    return views.turns(spark, sf).select("session_id", "turn", F.size(state.segment_list(F.col("labelled"))).cast("long").alias("segments")).where("segments > 0")


@query(FACTS + _FEW + f"SELECT session_id, turn, normalized FROM few p WHERE kind = 'pending_item' AND NOT EXISTS (SELECT 1 FROM few d WHERE d.kind = 'completed_item' AND d.session_id = p.session_id AND {_match('p.normalized', 'd.normalized')})")
def fuzzy_unresolved(spark: SparkSession, sf: str) -> DataFrame:
    return state.unresolved(_state_rows(spark, sf), "session_id").select("session_id", "turn", "normalized")


@query(FACTS + _FEW + ", folded AS (SELECT session_id, kind AS type, normalized, row_number() OVER (PARTITION BY session_id ORDER BY turn, line, cut, part) AS pos FROM few)" + fold_sql("folded", "fo", "session_id", (), "6") + "SELECT session_id, type AS kind, pos, normalized FROM fo")
def state_fold(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("turn", "line", "cut", "part"))
    return state.fold_dedupe(_state_rows(spark, sf).withColumn("pos", place), "session_id", "kind", limit=6)


@query(_SAID + f"SELECT *, {_REASONS} AS reasons, {_REASONS} = '' AS done, CASE WHEN {_REASONS} = '' THEN 'ready_to_close' ELSE string_split({_REASONS}, ',')[1] END AS primary_reason, claims > 0 AND {_REASONS} <> '' AS closure_mismatch FROM oi_counts")
def completion_check(spark: SparkSession, sf: str) -> DataFrame:
    return state.completion_check(_counted(spark, sf))


@query(_SAID + ", bc AS (SELECT *, CASE WHEN requests > 0 THEN 1 ELSE 0 END AS summaries FROM oi_counts) SELECT *, " + _BUDGET.format(*[f"'{b[0]}'" for b in state.BUDGETS], "'full'") + " AS budget, " + _BUDGET.format(*["'fits_open_work_profile'"] * 3, "'requires_full_profile'") + " AS budget_reason FROM bc")
def auto_budget(spark: SparkSession, sf: str) -> DataFrame:
    return state.auto_budget(_counted(spark, sf).withColumn("summaries", F.when(F.col("requests") > 0, 1).otherwise(0)))


_REPO = "'/work/team-' || doc_id % 5 || '/repo-' || doc_id % 9"
_PROJECTS = f""", listed AS (SELECT doc_id % 9 AS kind, CASE WHEN doc_id % 9 < 3 THEN {_REPO} || '/AGENTS.md' WHEN doc_id % 9 < 5 THEN {_REPO} || '/PROJECTS_STATE_' || doc_id % 7 || '.md'
  WHEN doc_id % 9 = 5 THEN {_REPO} || '/pyproject.toml' WHEN doc_id % 9 = 6 THEN '/srv/app/data-' || doc_id % 2 || '/.git/' || doc_id ELSE {_REPO} || '/notes/' || doc_id END AS path,
  CASE WHEN doc_id % 9 < 5 THEN 'scope-' || doc_id % 5 || '-' || doc_id % 9 END AS named FROM documents),
parts AS (SELECT DISTINCT string_split(path, '/') AS p FROM listed),
folders AS (SELECT DISTINCT array_to_string(p[:n], '/') AS folder FROM (SELECT p, unnest(range(1, len(p))) AS n FROM parts)),
marks AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, CASE WHEN kind < 3 THEN 0 ELSE 1 END AS rank, named AS key FROM listed WHERE kind < 5
 UNION ALL SELECT regexp_replace(path, '(/[.]git)?/[^/]*$', ''), 2, regexp_extract(path, '([^/]+)(/[.]git)?/[^/]*$', 1) FROM listed WHERE kind < 3 OR kind IN (5, 6)),
roots AS (SELECT folder, min({{'rank': rank, 'key': key}}) AS root FROM marks GROUP BY 1),
asked AS (SELECT m.session_id, m.pos, m.text, CASE m.session_id % 7 WHEN 3 THEN '/srv/app' WHEN 5 THEN NULL ELSE s.cwd END AS cwd FROM messages m JOIN sessions s USING (session_id)),
raw AS (SELECT session_id, pos, 0 AS place, cwd AS path FROM asked UNION ALL
 SELECT session_id, pos, unnest(range(1, len(x) + 1)), unnest(x) FROM (SELECT session_id, pos, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z]:[\\\\/][^\\s`"<>|]+')
   || regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])(/(?:[^\\s`"<>|]+/)*[^\\s`"<>|]+)', 1), lambda x: regexp_replace(trim(x), '[.,;:)\\]}}''"]+$', '')), lambda x: x <> '') AS x FROM asked)),
bare AS (SELECT DISTINCT path, regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') AS spot, nullif(regexp_extract(regexp_replace(replace(path, '\\', '/'), '/+$', ''), '[^/]*$'), '') AS leaf FROM raw WHERE path IS NOT NULL),
ups AS (SELECT path, n AS depth, array_to_string(p[:n], '/') AS folder FROM (SELECT path, string_split(spot, '/') AS p, unnest(range(1, len(string_split(spot, '/')) + 1)) AS n FROM bare)),
met AS (SELECT path, max({{'depth': depth, 'folder': folder}}) AS start, max({{'depth': depth, 'folder': folder, 'root': root}}) FILTER (root IS NOT NULL) AS mark FROM ups JOIN folders USING (folder) LEFT JOIN roots USING (folder) GROUP BY 1),
found AS (SELECT path, CASE WHEN marked THEN mark.root.key ELSE trim(leaf) END AS key, CASE WHEN marked THEN mark.folder ELSE CASE WHEN start.folder = '' THEN '/' ELSE start.folder END END AS root,
  CASE WHEN marked THEN ['AGENTS.md', 'PROJECTS_STATE', 'project_marker'][mark.root.rank + 1] ELSE 'leaf' END AS src, CASE WHEN NOT marked THEN 'low' WHEN mark.root.rank < 2 THEN 'high' ELSE 'medium' END AS sure
 FROM (SELECT *, coalesce(mark.depth > start.depth - 10, false) AS marked FROM bare LEFT JOIN met USING (path)) WHERE leaf IS NOT NULL AND lower(leaf) NOT IN ('tmp', 'temp', 'windows', 'winnt', 'system32', 'syswow64')),
places AS (SELECT r.session_id, r.pos, r.place, r.path, a.cwd, f.key, f.root, f.src, f.sure FROM raw r JOIN asked a USING (session_id, pos) JOIN found f ON f.path = r.path),
picks AS (SELECT session_id, pos, any_value(cwd) AS cwd, min({{'key': key, 'root': root, 'src': src, 'sure': sure}}) FILTER (place = 0) AS here, arg_min({{'key': key, 'root': root, 'src': src, 'sure': sure}}, place) FILTER (place > 0) AS anywhere,
  arg_min({{'key': key, 'root': root, 'src': src, 'sure': sure}}, place) FILTER (place > 0 AND (path = cwd OR starts_with(path, cwd || '/'))) AS inside, list(key) FILTER (place > 0) AS keys FROM places GROUP BY ALL),
picked AS (SELECT a.session_id, a.pos, p.* EXCLUDE (session_id, pos, cwd), CASE WHEN a.cwd IS NULL THEN CASE WHEN anywhere IS NULL THEN 'none' ELSE 'anywhere' END WHEN here.sure <> 'low' THEN 'sure' WHEN inside IS NOT NULL THEN 'inside' ELSE 'here' END AS how
 FROM asked a LEFT JOIN picks p USING (session_id, pos)),
chosen AS (SELECT *, CASE how WHEN 'anywhere' THEN anywhere WHEN 'inside' THEN inside WHEN 'none' THEN NULL ELSE here END AS x FROM picked)
SELECT session_id, pos, coalesce(x.key, 'default-project') AS project_key, x.root AS root_path, CASE how WHEN 'none' THEN 'fallback' WHEN 'sure' THEN 'cwd:' || x.src WHEN 'here' THEN 'cwd:' || x.src ELSE 'mentioned_path:' || x.src END AS source,
 coalesce(x.sure, 'low') AS confidence, CASE WHEN how IN ('inside', 'here') THEN 'cwd_did_not_resolve_to_project' WHEN how = 'sure' AND len(list_filter(coalesce(keys, []), lambda k: k <> here.key)) > 0 THEN 'mentioned_path_ignored_due_to_cwd_project' ELSE '' END AS warnings
FROM chosen""".replace("\\\\", "\\")


@query(_PROJECTS)
def project_identity(spark: SparkSession, sf: str) -> DataFrame:
    """The project of every message: by marks of the folders that its session works in or its text names."""
    said = views.messages(spark, sf).join(views.sessions(spark, sf).select("session_id", "cwd"), "session_id")
    cwd = F.when(F.col("session_id") % 7 == 3, "/srv/app").when(F.col("session_id") % 7 != 5, F.col("cwd"))
    rows = said.select("session_id", "pos", cwd.alias("cwd"), notify.mentioned(F.array("text")).alias("paths"))
    rows = identity.looked_up(rows, views.listing(spark, sf))
    who = identity.identity(None, F.lit(None).cast("string"), F.col("cwd"), F.col("places"), True)
    return rows.select("session_id", "pos", who.alias("who")).select(
        "session_id", "pos", "who.project_key", "who.root_path", "who.source", "who.confidence", F.array_join("who.warnings", ",").alias("warnings"),
    )


_ALL = f""", oa AS MATERIALIZED (SELECT *, [w FOR w IN list_distinct(string_split(normalized, ' ')) IF w <> '' AND w NOT IN {tuple(T.STATE_STOPWORDS)}] AS words FROM
 (SELECT id, project_key, type, updated_at, {_NORMAL.format('detail')} AS normalized FROM observations WHERE type IN ('pending_item', 'blocker', 'completed_item', 'constraint')) WHERE normalized <> '')"""
_MEET = """a.project_key = b.project_key AND (a.normalized = b.normalized OR (length(a.normalized) >= 18 AND contains(b.normalized, a.normalized)) OR (length(b.normalized) >= 18 AND contains(a.normalized, b.normalized))
 OR (len(a.words) > 0 AND len(b.words) > 0 AND (list_has_all(a.words, b.words) OR list_has_all(b.words, a.words))))"""


def _state_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts of all observations that state compares, in their normal form."""
    rows = views.observations(spark, sf, status=False).where(F.col("type").isin("pending_item", "blocker", "completed_item", "constraint"))
    return cut(rows.select("id", "project_key", "type", "updated_at", T.normalize_state(F.col("detail")).alias("normalized")).where("normalized <> ''"))


@query(_ALL + f"""SELECT a.id, a.project_key, a.type, min({{'updated_at': b.updated_at, 'id': b.id}}).id AS completed_id FROM oa a JOIN oa b ON {_MEET}
 WHERE a.type IN ('pending_item', 'blocker') AND b.type = 'completed_item' GROUP BY 1, 2, 3""")
def contradictions_all(spark: SparkSession, sf: str) -> DataFrame:
    """Of all open items of a project, not only those of its state, each that a completed text matches, with the first such."""
    rows = _state_texts(spark, sf)
    found = fuzzy.first_matches(rows.where("type in ('pending_item', 'blocker')"), rows.where("type = 'completed_item'"), "project_key", ["updated_at", "id"], ["id"])
    return found.select("id", "project_key", "type", F.col("match.id").alias("completed_id"))


@query(_ALL + f""", sides AS (SELECT *, id % 24 < 12 AS now FROM oa WHERE type <> 'completed_item')
SELECT a.id, a.project_key, a.type, CASE WHEN a.now THEN 'added' ELSE 'removed' END AS change FROM sides a WHERE NOT EXISTS (SELECT 1 FROM sides b WHERE b.now <> a.now AND {_MEET})""")
def state_delta_all(spark: SparkSession, sf: str) -> DataFrame:
    """What all watched texts of a project have that those of its other half of ids match nowhere, both ways."""
    rows = _state_texts(spark, sf).where("type <> 'completed_item'")
    now = F.col("id") % 24 < 12
    return fuzzy.changed(rows.where(now), rows.where(~now), "project_key").select("id", "project_key", "type", "change")


from continuo import state_queries  # noqa: E402, F401 - registers the queries on notes, sessions, state, changes and packs
