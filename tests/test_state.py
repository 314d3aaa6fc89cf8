"""Notes, sessions, changes and full extraction on small cases, against values worked out by hand or in plain Python."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from continuo import registry
from continuo.functions import folding as fd
from continuo.functions import text as T
from continuo.operators import changes, notes, scope, state
from continuo.operators.retrieval import recent, search
from continuo.operators.search import parse
from continuo.plans import views
from continuo.plans.session import steady

NOTE = "id long, title string, summary string, detail string, status string, importance int"
ITEM = "project_key string, type string, id long, summary string, detail string, title string, updated_at long"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("text", ["Café_Über  Straße", "ÉTION\tçà", "e\u0301 a_b", "Ångström Łódź", "", "Ελλάς ΐ"])
def test_fold_equals_the_unicode_rule(spark, text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    want = " ".join(plain.replace("_", "-").split())
    got = frame(spark, [(text,)], "t string").select(fd.fold(F.col("t"))).first()[0]
    assert got.replace("ς", "σ") == want == fd.fold_query(text)


def test_tags_paths_and_slugs(spark):
    row = frame(spark, [("x\n tags: a, b  c,,a\nTAGS: d", "C:\\Work\\Repo-1\\", "-- Big  Label! --")], "d string, p string, s string")
    got = row.select(fd.detail_tags(F.col("d")), fd.path_leaf(F.col("p")), fd.slug(F.col("s")), fd.tag_key(F.lit("Café Notes!"))).first()
    assert list(got) == [["a", "b c", "d"], "Repo-1", "big-label", "cafe-notes"]
    paths = frame(spark, [("/a/b/c", "/A/b/"), ("/a/bc", "/a/b"), (None, "/a"), ("/a", "/a/b")], "p string, r string")
    assert [r[0] for r in paths.select(fd.within(F.col("p"), F.col("r"))).collect()] == [True, False, True, False]


def test_note_score_by_hand(spark):
    rows = frame(spark, [(1, "Release hold", "keep it", "keep it\n\nTags: freeze", "active", 4), (2, "Other", "nothing", "x", "active", 5), (3, "Release hold", "x", "x", "retired", 5), (4, None, None, None, None, None)], NOTE)
    got = {r.id: r.note_score for r in notes.score(rows, "release hold").collect()}
    # base 8, direct 2 x 4, alias "freeze" 2, groups 2 x 3, importance 8 + 4, boosted 4, title words 2 x 2, same title 60, in title 20, active 2, stable phrase 2
    assert got == {1: 8 + 8 + 2 + 6 + 12 + 4 + 4 + 60 + 20 + 2 + 2}
    assert notes.score(rows, " ").count() == 0


def test_note_identifier_and_meta_gate(spark):
    rows = frame(spark, [(1, "t", "see run_2024-x1", "", "active", 1), (2, "t", "see arun_2024-x1", "", "active", 1), (3, "alpha", "alpha beta", "alpha beta\nTags: test", "active", 1)], NOTE)
    assert {r.id for r in notes.score(rows, "run_2024-x1").where("note_score > 80").collect()} == {1}
    assert notes.score(rows, "alpha beta").count() == 0  # a meta tag asks for more
    assert notes.opaque_identifier("short1-") is None and notes.opaque_identifier("Run_2024") == "run-2024"


def test_every_observation_is_a_note(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(r.doc_id for r in documents.select("doc_id").collect())
    assert sorted(r.id for r in views.notes(spark, sf).select("id").collect()) == want
    assert sorted(r.id for r in registry.QUERIES["fold_text"](spark, sf).collect()) == want


def test_notes_create_and_merge(spark):
    raw = frame(spark, [("p", 1, "  a   b ", None, ["x", " x ", ""], 9), ("p", 1, "a b", "", ["x"], 2), ("p", 1, "  ", "t", [], 1), ("p", None, None, None, None, None)], "project_key string, session_id long, text string, title string, tags array<string>, importance int")
    got = [(r.title, r.detail, r.importance) for r in notes.create(raw).collect()]
    assert got == [("Manual note: a b", "a b\n\nTags: x", 2)]
    found = frame(spark, [(1, 0, -1.0, 5), (2, 7, -2.0, 6)], "id long, priority int, rank double, updated_at long")
    known = frame(spark, [(2, 7, 6), (3, 7, 7)], "id long, priority int, updated_at long")
    scored = frame(spark, [(3, 20.0)], "id long, note_score double")
    assert [r.id for r in notes.merge_ranked(found, scored, known).collect()] == [3, 1]


def test_session_labels(spark):
    sessions = frame(spark, [(1, "s-1", "/w/repo-a"), (2, "s-2", "/w/docs"), (3, "s-3", None)], "session_id long, external_id string, cwd string")
    messages = frame(spark, [(1, 0, "Generate a short title please"), (1, 1, "fix repo-a now"), (2, 0, "x User prompt:  do  it"), (3, 0, " "), (3, 1, None)], "session_id long, pos long, text string")
    got = {r.session_id: (r.display_label, r.source, r.suppressed, r.sub_scope) for r in scope.label(sessions, messages, "session_id").collect()}
    assert got == {1: ("repo-a · fix repo-a now", "first_input", True, "repo-a"), 2: ("s-2 · do it", "embedded_user_prompt", True, None), 3: ("s-3", "fallback", False, None)}


def test_sub_scope_ties_and_paths(spark):
    rows = frame(spark, [(1, None, "B-x a-x"), (2, "/w/src", "see /srv/app-1/x and app-1"), (3, None, "nothing"), (4, None, None)], "session_id long, cwd string, text string")
    got = {r.session_id: (r.sub_scope, r.candidates, r.source, r.confidence) for r in scope.infer_sub_scope(rows, "session_id").collect()}
    assert got == {1: ("a-x", ["a-x", "B-x"], "text_mention", "low"), 2: ("app-1", ["app-1"], "path_mention", "medium")}


def test_resolve_and_lanes(spark):
    schema = "session_id long, external_id string, cwd string, sub_scope string, display_label string, preview string, last_turn_at long"
    rows = frame(spark, [(1, "s1", "/w/repo-a", "repo-a", "repo-a · parser", "parser", 10), (2, "s2", "/w/repo-b", "repo-b", "repo-b · docs", "docs", 20), (3, "s3", "/w/Lab", None, None, None, None)], schema)
    got = [(r.session_id, r.score, r.confidence, r.signals) for r in scope.resolve(rows, "repo-a parser", repo_path="/x/repo-a").collect()]
    assert got[0][:3] == (1, 80 + 60 + 100 + 30 + 16, "high") and got[1][:3] == (2, 30 + 8, "low")
    assert "path_hint_exact_match" in got[0][3]
    assert [r.session_id for r in scope.resolve(rows).collect()] == [2, 1]
    assert scope.resolve(rows, "s3").first().score == 220 + 8
    assert [(r.lane, r.session_count, r.session_ids) for r in scope.lanes(rows.withColumn("score", F.lit(0))).collect()] == [("repo-b", 1, [2]), ("repo-a", 1, [1])]


def state_of(rows):
    steady(rows.sparkSession)
    items = changes.state_items(rows, "project_key")
    return items, state.open_work(items, "project_key")


def test_changes_contradictions_and_repairs(spark):
    now = 100 * 86_400
    rows = [("p", "pending_item", 1, "write the docs", 1), ("p", "completed_item", 2, "docs write", 2), ("p", "blocker", 3, "no access yet", 3), ("p", "blocker", 4, "access missing", 4), ("p", "pending_item", 5, "ship", now), ("p", "blocker", 6, "write docs", 7)]
    obs = frame(spark, [(k, t, i, s, s, s, u) for k, t, i, s, u in rows], ITEM)
    governed = changes.governed(obs, "project_key")
    items, left = state_of(governed)
    assert {r.id for r in items.collect()} == {1, 2, 3, 5, 6}  # both blockers have one normal form, the oldest stays
    assert {r.id for r in left.collect()} == {3, 5, 6}
    checked = state.completion_check(state.counts(items, left, "project_key"))
    assert [(r.kind, r.left_text, r.right_text) for r in changes.contradictions(items, left, checked, "project_key").collect()] == [("blocker_vs_completed", "write docs", "docs write")]
    before = changes.earlier(obs, "project_key", 4)
    old_items, old_left = state_of(before)
    found = changes.delta(changes.watched(items, left, "project_key"), changes.watched(old_items, old_left, "project_key"), "project_key")
    assert {(r.part, r.change, r.id) for r in found.collect()} == {("pending", "added", 5), ("blocker", "added", 6)}
    old = changes.stale(items, left, "project_key", now)
    assert {(r.kind, r.summary) for r in old.collect()} == {("blocker", "no access yet"), ("blocker", "write docs")}
    copies = changes.duplicates(governed, "project_key")
    assert [(r.n, r.ids, r.latest) for r in copies.collect()] == [(2, [3, 4], "no access yet")]
    fixes = changes.repairs(copies, governed, old, "project_key", obs.where("id = 6").select("id"))
    assert {(r.repair_kind, r.id) for r in fixes.collect()} == {("archive_duplicate_observations", 4), ("archive_stale_open_items", 3)}
    assert {r.id for r in changes.without_repaired(obs, fixes).collect()} == {1, 2, 5, 6}
    guard = state.scope_guard(items, left, "project_key").first()
    assert guard.must_not_drop == ["ship", "no access yet", "write docs"] and guard.flags == ["pending_work_open", "blockers_open"]
    empty = changes.governed(obs.where("false"), "project_key")
    assert changes.state_items(empty, "project_key").count() == changes.duplicates(empty, "project_key").count() == 0


def test_a_claim_without_evidence_is_a_mismatch_without_open_work(spark):
    obs = frame(spark, [("p", "completion_claim", 1, "we are done", "", "", 1)], ITEM)
    items, left = state_of(changes.governed(obs, "project_key"))
    guard = state.scope_guard(items, left, "project_key").first()
    assert guard.flags == ["closure_mismatch"] and guard.must_not_drop is None
    assert state.completion_check(state.counts(items, left, "project_key")).first().reasons == "missing_evidence"


def test_governed_rows_are_the_oldest_of_the_newest(spark):
    obs = frame(spark, [("p", "blocker", k, f"b{k}", "", "", k // 2) for k in range(600)] + [("p", "decision", 900, "d", "", "", 900)], ITEM)
    got = [r.id for r in changes.governed(obs, "project_key").orderBy("pos").collect()]
    want = sorted(sorted(range(600), key=lambda k: (k // 2, k))[-480:], key=lambda k: (k // 2, str(k)))[:160]
    assert got == want
    lead = [r.id for r in changes.governed(obs, "project_key", F.col("id") == 599).orderBy("pos").collect()]
    assert lead == [599, *want[:159]]


def test_state_keeps_items_behind_wordings_of_one_text(spark):
    words = ["fix the parser", "fix parser now", "please fix the parser", "parser fix", "fix the parser today", "still fix parser soon", "fix a parser"]
    rows = [("p", "pending_item", n + 10, s) for n, s in enumerate(words)] + [("p", "pending_item", 110, "write the docs"), ("p", "blocker", 111, "no access yet"), ("q", "pending_item", 8, "fix parser")]
    # not transitive: "a b" drops "a b c", which would have dropped "b c", so that stays
    rows += [("r", "constraint", 5, "a1 b1"), ("r", "constraint", 6, "a1 b1 c1"), ("r", "constraint", 7, "b1 c1"), ("r", "objective", 3, "one"), ("r", "objective", 4, "two")]
    rows += [("s", "completed_item", 200 + n, f"task number{n}") for n in range(9)] + [("s", "pending_item", 300 + n, f"common lead {n % 3} x{n}") for n in range(30)] + [("s", "pending_item", 400, "lead 1")]
    obs = frame(spark, [(k, t, i, s, s, s, i) for k, t, i, s in rows], ITEM)
    norm = {r.id: r.n for r in obs.select("id", changes.state_text().alias("n")).collect()}

    def matches(a, b):  # the match in plain Python
        x, y = ({w for w in t.split() if w not in T.STATE_STOPWORDS} for t in (a, b))
        return a == b or (len(a) >= 18 and a in b) or (len(b) >= 18 and b in a) or bool(x and y and (x <= y or y <= x))

    want = set()
    for key, kind in {(k, t) for k, t, _, _ in rows}:
        kept = []
        for i in sorted(i for k, t, i, _ in rows if (k, t) == (key, kind)):
            if len(kept) < changes.STATE_LIMITS[kind] and not any(matches(norm[i], norm[j]) for j in kept):
                kept.append(i)
        want |= set(kept)
    items, left = state_of(changes.governed(obs, "project_key"))
    assert {r.id for r in items.collect()} == want >= {110, 7, 5, 3} and not want & {6, 4}
    assert {r.summary for r in left.where("project_key = 'p'").collect()} >= {"write the docs", "no access yet"}


def test_turn_observations(spark):
    schema = "session_id string, turn_id string, runtime string, input_messages array<string>, assistant_message string"
    rows = [
        ("s", "1", "agent", ["Goal: ship; Pending: docs", "", "Pending: docs"], "- Decision: use Spark\nresolved: use spark\nDone: parser\nStatus: done"),
        ("s", "2", "agent", ["please use mem_search now"], "Pending: x"),
        ("s", "3", None, None, None),
    ]
    got = state.turn_observations(frame(spark, rows, schema), "session_id", "turn_id").collect()
    first = sorted((r.type, r.summary) for r in got if r.turn_id == "1")
    assert first == sorted([
        ("session_summary", "| Pending: docs -> - Decision: use Spark resolved: use spark Done: parser Status: done"), ("decision", "use Spark"), ("objective", "ship"), ("pending_item", "docs"), ("pending_item", "docs"),
        ("user_request", "Goal: ship; Pending: docs"), ("user_request", "Pending: docs"), ("completed_item", "parser"), ("completion_claim", "assistant claimed the work was complete"),
    ])
    assert not [r for r in got if r.turn_id == "2"] and [(r.type, r.summary) for r in got if r.turn_id == "3"] == [("session_summary", "No user message ->")]
    weights = {r.type: (r.title, r.importance, r.confidence) for r in got}
    assert weights["decision"] == ("Decision: use Spark", 4, 0.75) and weights["completed_item"] == ("Completed: parser", 3, 0.7)


def test_segments_against_plain_python(spark):
    texts = ["Goal: a b; Todo: c Blocker: d\nproject dod: e session dod: f", "x ; ; y\r\n\r\nRisk - z Done: q", ";"]

    def plain(text):
        inline = re.compile(state.INLINE)
        return [s.strip() for line in re.split(r"\r\n|\n|\r", text) for part in re.split(r"\s*;\s*", line.strip()) for s in inline.split(part.strip()) if s.strip()]

    rows = frame(spark, list(enumerate(texts)), "id long, text string")
    got = {i: [] for i in range(len(texts))}
    for r in state.segments(rows, "text", "id").orderBy("id", "line", "cut", "part").collect():
        got[r.id].append(r.segment)
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_recent_of_an_empty_table(spark):
    assert recent(frame(spark, [], "id long, updated_at long")).count() == 0


def test_phrases_prefixes_and_accents(spark):
    rows = frame(spark, [(1, 0, "Café noir", "the old café", "", 5), (2, 0, "noir", "cafe", "", 6), (3, 0, "cafeteria", "x", None, 7)], "id long, priority int, title string, summary string, detail string, updated_at long")
    ids = lambda q: sorted(r.id for r in search(rows, q).collect())
    assert ids("CAFÉ") == [1, 2] and ids("cafe*") == [1, 2, 3]
    assert ids('"cafe noir"') == [1] and ids('"noir cafe"') == []  # no phrase runs from one column into the next
    assert ids('"old caf"*') == [1] and ids('noir "old cafe"') == [1]
    assert ids("cafe NOT old") == [2] and ids("x OR old") == [1, 3] and ids("(x OR old) AND noir") == [1] and ids("title:noir") == [1, 2] and ids("-title : cafe") == [1, 2] and ids("{title summary}: x") == [3] and ids("old + cafe") == [1]
    assert parse("Straße")[1] == [(("straße",), False, ("title", "summary", "detail"))] and parse('"a-b"* c')[1][0][:2] == (("a", "b"), True)
    for odd in ("v1.0", "a-b", "what?", "NOT", "a AND", "name:x", "a (b)", r"C:\repo", "NEAR(a b)", '"open'):
        assert parse(odd) is None, odd
    assert parse('""') == (None, []) and search(rows, '""').count() == 0


def test_substrings_take_backslashes_and_ascii_case(spark):
    rows = frame(spark, [(1, 0, r"see C:\Repo\x", "", "", 1), (2, 0, "100%_sure É", "", None, 2)], "id long, priority int, title string, summary string, detail string, updated_at long")
    ids = lambda q: sorted(r.id for r in search(rows, q).collect())
    assert ids(r"c:\rEPO") == [1] and ids("0%_SURE") == [2] and ids("sure-é") == [] and ids("e é?") == []


def test_a_pack_extracts_once(spark, sf, monkeypatch):
    from continuo import state_queries

    cut, made = state_queries.cut, []
    monkeypatch.setattr(state_queries, "cut", lambda df: made.append(cut(df)) or made[-1])
    parts = state_queries.pack_inputs(spark, sf)
    assert len(made) == 1 and {"id", "type", "summary", "detail"} <= set(made[0].columns)
    if made[0].inputFiles():  # each part of the facts reads the table that they were written to
        assert all(set(made[0].inputFiles()) & set(p.inputFiles()) for p in parts[:3])
