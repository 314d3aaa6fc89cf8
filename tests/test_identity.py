"""Project identity by the marks of roots: guides, state files, manifests, names, and what a listing may hold."""

import json

from continuo.engine import Engine
from continuo.operators import identity
from continuo.sources.notify import notify_to_envelope

GUIDED = "# Guide\n\nScope: `trip-studio`\n"
STALE = "# Guide\n<!-- any-tool:generated-context:start -->\nScope: `stale-project`\n<!-- any-tool:generated-context:end -->\n"


def listed(spark, *files):
    return spark.createDataFrame(list(files), "path string, text string")


def resolved(spark, files, *payloads, from_cwd=True):
    rows = [(json.dumps({"type": "agent-turn-complete", "thread-id": "t", "turn-id": str(n), **p}),) for n, p in enumerate(payloads)]
    out = notify_to_envelope(spark.createDataFrame(rows, "value string"), None, from_cwd, files)
    about = {int(r.turn_id): (r.project_key, r.metadata) for r in out.collect()}
    short = ("project_root_path", "project_resolution_source", "project_resolution_warnings")
    return [(about[n][0], *[about[n][1].get(name) for name in short]) for n in range(len(payloads))]


def test_projects_are_known_by_marks(spark):
    files = listed(
        spark, ("/w/guided/AGENTS.md", GUIDED), ("/w/active/AGENTS.md", STALE), ("/w/state/PROJECTS_STATE_ts.md", "# x\n\nNombre canonico:\n\n- `canon`\n"),
        ("/w/mono/package.json", None), ("/w/mono/lib/deep/.git/HEAD", None), ("/home/me/notes.txt", None), ("D:\\Code\\Repo\\go.mod", None),
    )
    unsure, other = "cwd_did_not_resolve_to_project", "mentioned_path_ignored_due_to_cwd_project"
    told = {"input-messages": ["look at `/w/guided/src/a.py`, please."]}
    got = resolved(
        spark, files, {"cwd": "/w/guided"}, {"cwd": "/w/guided/src/not/there"}, {"cwd": "/w/active"}, {"cwd": "/w/state"}, {"cwd": "/w/mono/lib"}, {"cwd": "/w/mono/lib/deep/x"},
        {"cwd": "/w/active", **told}, {"cwd": "/w", **told}, {"cwd": "/home/me", **told}, {"cwd": "C:\\WINDOWS\\System32", **told}, told, {"cwd": "d:\\code\\repo\\sub"}, {},
        {"cwd": "/w/active", "workspace-key": "named"}, {"cwd": "/w/guided/AGENTS.md"},
    )
    assert got == [
        ("trip-studio", "/w/guided", "cwd:AGENTS.md", None), ("trip-studio", "/w/guided", "cwd:AGENTS.md", None), ("active", "/w/active", "cwd:project_marker", None),
        ("canon", "/w/state", "cwd:PROJECTS_STATE", None), ("mono", "/w/mono", "cwd:project_marker", None), ("deep", "/w/mono/lib/deep", "cwd:project_marker", None),
        ("active", "/w/active", "cwd:project_marker", other), ("trip-studio", "/w/guided", "mentioned_path:AGENTS.md", unsure), ("me", "/home/me", "cwd:leaf", unsure),
        ("default-project", None, "fallback", "technical_cwd_ignored"), ("trip-studio", "/w/guided", "mentioned_path:AGENTS.md", None), ("Repo", "D:/Code/Repo", "cwd:project_marker", None),
        ("default-project", None, "fallback", None), ("named", "/w/active", "payload_project_key", None), ("trip-studio", "/w/guided", "cwd:AGENTS.md", None),
    ]


def test_roots_and_their_limits(spark):
    deep = "/r/" + "/".join("abcdefghij")  # the root is the eleventh folder from here
    files = listed(
        spark, ("/r/go.mod", None), (deep + "/f", None), ("/tmp/package.json", None), ("/s/PROJECTS_STATE_a.md", "nothing"), ("/s/PROJECTS_STATE_b.md", None),
        ("/s/PROJECTS_STATE_c.md", "Nombre canonico: `inline`"), ("/u/PROJECTS_STATE_1.md", ""), ("/u/PROJECTS_STATE_2.md", ""), ("/u/PROJECTS_STATE_3.md", ""),
        ("/u/PROJECTS_STATE_4.md", "Nombre canonico:\n- late"), ("/v/AGENTS.md", "Scope: temp\nScope: real"), ("/v/AGENTS.md", "Scope: temp\nScope: real"), (None, GUIDED), ("", GUIDED),
    )
    known = {r.folder: r.root and tuple(r.root) for r in identity.folders(files).collect()}
    assert known["/r"] == (2, "r") and known["/tmp"] is None and known["/s"] == (1, "inline") and known["/u"] is None and known["/v"] == (2, "v") and known[""] is None
    paths = spark.createDataFrame([(deep,), (deep + "/gone/x",), ("/r/" + "/".join("abcdefghi"),), ("/tmp/x",), ("/tmp",), (None,), ("",), ("/",), ("no/path",), ("/tmp/x",)], "path string")
    got = {r.path: r.found and tuple(r.found) for r in identity.resolve(paths, identity.folders(files)).collect()}
    assert got == {
        deep: ("j", deep, "leaf", "low"), deep + "/gone/x": ("x", deep, "leaf", "low"), "/r/" + "/".join("abcdefghi"): ("r", "/r", "project_marker", "medium"),
        "/tmp/x": ("x", "/tmp", "leaf", "low"), "/tmp": None, "": None, "/": None, "no/path": ("path", None, "leaf", "low"),
    }
    none = listed(spark, ("/a/b", None)).where("false")
    assert identity.folders(none).count() == 0
    assert resolved(spark, none, {"cwd": "/w/x"}, {}) == [("x", None, "cwd:leaf", "cwd_did_not_resolve_to_project"), ("default-project", None, "fallback", None)]


def test_a_store_keeps_the_root(spark, tmp_path):
    payload = {"type": "agent-turn-complete", "thread-id": "t", "turn-id": "1", "cwd": "/w/active/src", "input-messages": ["Objective: start"], "timestamp": "2026-05-07T00:00:00Z"}
    engine = Engine(spark, str(tmp_path))
    engine.ingest_notify(spark.createDataFrame([(json.dumps(payload),)], "value string"), None, True, listed(spark, ("/w/active/AGENTS.md", STALE)))
    assert [(r.project_key, r.root_path) for r in engine.store.projects().collect()] == [("active", "/w/active")]
