"""Which project a folder or a mentioned path belongs to: marked roots of a listing of files, joined by the deepest folder.

A listing has a row a file: path, and its text where the name is one of TEXT_MARKS (null elsewhere). Nothing opens a
folder while turns are resolved, so a listing can come from any file system, and of any number of machines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from continuo.functions import folding as fd
from continuo.functions import text as T
from continuo.operators.changes import leading

#: Names that are no project; the key where nothing names one.
TECHNICAL = ("", "system32", "syswow64", "windows", "winnt", "temp", "tmp", "program files", "program files (x86)")
FALLBACK = "default-project"
#: Files whose text names a project (a guide, a state file), names that mark a root without text, how many
#: state files of a folder count, how many lines below its heading a name may be, and how many folders up count.
GUIDE, STATE_FILE = "AGENTS.md", r"^PROJECTS_STATE_.*\.md$"
MARKERS = (".git", "AGENTS.md", "package.json", "pyproject.toml", "Cargo.toml", "go.mod")
STATE_FILES, NAME_LINES, FOLDERS_UP = 3, 7, 10
#: The line of a guide and the heading of a state file that name the project; text that a tool generated.
SCOPE = r"(?im)^\s*Scope:\s*`?([^`\r\n]+)`?\s*$"
HEADING, INLINE = r"(?i)Nombre\s+canonico", r"(?i)Nombre\s+canonico:\s*(?:\r?\n\s*-\s*)?`?([^`\r\n]+)`?"
GENERATED = r"(?is)<!--\s*[\w.-]+:generated-context:start\s*-->.*?(?:<!--\s*[\w.-]+:generated-context:end\s*-->|$)"
#: What a root was known by, best first, and how sure that is.
BY = ("AGENTS.md", "PROJECTS_STATE", "project_marker")
CONFIDENCE = ("high", "high", "medium")
#: Of a path: the key of its project, the root or else the deepest folder that exists, by what, how sure.
FOUND = "struct<project_key:string,root_path:string,by:string,confidence:string>"


def usable(key: Column) -> Column:
    """The trimmed key, null if it names no project."""
    bare = F.trim(key)
    return F.when(~F.lower(bare).isin(*TECHNICAL), bare)


def is_technical(path: Column) -> Column:
    flat = F.lower(F.trim(F.translate(path, "/", "\\")))
    leaf = F.lower(F.coalesce(fd.path_leaf(path), F.lit("")))
    return leaf.isin(*TECHNICAL) | F.contains(flat, F.lit("\\windows\\system32")) | F.endswith(flat, F.lit("\\windows"))


def spot(path: Column) -> Column:
    """One form of a path: plain slashes where it has a drive, none doubled or last. The topmost folder is the empty text.

    ``.``, ``..`` and links stay as they are.
    """
    plain = F.when(path.rlike(r"^[A-Za-z]:[\\/]"), F.translate(path, "\\", "/")).otherwise(path)
    return F.regexp_replace(F.regexp_replace(plain, "/+", "/"), "/$", "")


def same(place: Column) -> Column:
    """What equal places have in common: with a drive, case doesn't count."""
    return F.when(place.rlike("^[A-Za-z]:(?:/|$)"), F.lower(place)).otherwise(place)


def below(path: Column, folder: Column) -> Column:
    p, f = same(spot(path)), same(spot(folder))
    return (p == f) | F.startswith(p, F.concat(f, F.lit("/")))


def _ups(path: Column) -> Column:
    """(depth, folder) of a path and all folders above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("folder")))


def _first(xs: Column) -> Column:
    return F.get(F.filter(xs, lambda x: x.isNotNull()), 0)


def _named_by_state(text: Column) -> Column:
    """The name below the first heading, else beside a heading, else below a later one."""
    lines = F.split(text, T.LINE_END)
    heads = F.filter(F.transform(lines, lambda line, n: F.when(line.rlike(HEADING), n)), lambda n: n.isNotNull())
    clean = lambda line: usable(F.regexp_replace(F.regexp_replace(T.strip(line), r"^-\s*", ""), "^[` ]+|[` ]+$", ""))
    under = F.transform(heads, lambda n: _first(F.transform(F.slice(lines, n + 2, NAME_LINES), clean)))
    beside = usable(F.regexp_replace(T.strip(F.regexp_extract(text, INLINE, 1)), "^[` ]+|[` ]+$", ""))
    return F.coalesce(F.get(under, 0), beside, _first(under))


def folders(files: DataFrame) -> DataFrame:
    """place, folder, root: every folder of the listing once, with its project (rank, key) if it is marked.

    Rows without a path are left out. Of a path that is listed twice the smaller key counts. A null text names nothing.
    """
    listed = files.where("path is not null and path <> ''").select(spot(F.col("path")).alias("path"), "text")
    listed = listed.withColumns({"name": F.substring_index("path", "/", -1), "ups": _ups(F.col("path"))})
    parent = lambda n: F.get(F.col("ups.folder"), F.size("ups") - n)  # noqa: E731 - 1 is the path itself
    name = F.col("name")
    guide = F.regexp_extract(F.regexp_replace("text", GENERATED, ""), SCOPE, 1)
    place = same(parent(2)).alias("place")
    by_guide = listed.where(name == GUIDE).select(place, F.lit(0).alias("rank"), usable(T.strip(guide)).alias("key"))
    by_state = listed.where(name.rlike(STATE_FILE)).groupBy(place, "name").agg(F.min(_named_by_state(F.col("text"))).alias("key"))
    by_state = leading(by_state, ["place"], STATE_FILES, "name").groupBy("place").agg(F.min_by("key", F.when(F.col("key").isNotNull(), F.col("name"))).alias("key"))
    every = listed.select(F.explode("ups").alias("up"), F.size("ups").alias("n")).select("up.folder", (F.col("up.depth") == F.col("n")).alias("is_file"))
    every = every.groupBy(same(F.col("folder")).alias("place")).agg(F.min("folder").alias("folder"), F.min("is_file").alias("is_file"))
    holder, leaf = F.regexp_replace("folder", "/?[^/]*$", ""), lambda c: F.substring_index(c, "/", -1)
    marked = every.where(leaf("folder").isin(*MARKERS)).select(holder.alias("folder"))
    marked = marked.select(same(F.col("folder")).alias("place"), F.lit(2).alias("rank"), usable(leaf("folder")).alias("key"))
    roots = by_guide.unionByName(by_state.withColumn("rank", F.lit(1))).unionByName(marked).where("key is not null")
    roots = roots.groupBy("place").agg(F.min(F.struct("rank", "key")).alias("root"))
    return every.where("not is_file").select("place", "folder").join(roots, "place", "left")


def found_by_name(path: Column) -> Column:
    """FOUND of a path whose folders nobody knows: its last part."""
    key = F.when(~is_technical(path), usable(fd.path_leaf(path)))
    none = F.lit(None).cast("string")
    return F.when(key.isNotNull(), F.struct(key.alias("project_key"), none.alias("root_path"), F.lit("leaf").alias("by"), F.lit("low").alias("confidence")))


def resolve(paths: DataFrame, known: DataFrame) -> DataFrame:
    """path, found (see FOUND): each distinct path with its deepest marked root, else by its last part, else null.

    A path that doesn't exist starts at its deepest folder that does; FOLDERS_UP folders from there on count. Folders high
    up meet every path, but on the side of ``known`` they are one row each, so the runtime can split the other side.
    """
    asked = paths.where("path is not null").select("path").distinct()
    ups = asked.where(~is_technical(F.col("path"))).select("path", F.explode(_ups(spot(F.col("path")))).alias("up")).select("path", "up.depth", same(F.col("up.folder")).alias("place"))
    met = ups.join(known, "place").groupBy("path").agg(F.max(F.struct("depth", "folder")).alias("start"), F.max(F.when(F.col("root").isNotNull(), F.struct("depth", "folder", "root"))).alias("mark"))
    near = F.col("mark.depth") > F.col("start.depth") - FOLDERS_UP
    shown = lambda c: F.when(F.col(c) == "", "/").otherwise(F.col(c))
    rank = F.col("mark.root.rank")
    by_mark = F.struct(
        F.col("mark.root.key").alias("project_key"), shown("mark.folder").alias("root_path"),
        F.element_at(F.array(*map(F.lit, BY)), rank + 1).alias("by"), F.element_at(F.array(*map(F.lit, CONFIDENCE)), rank + 1).alias("confidence"),
    )
    by_name = found_by_name(F.col("path"))
    placed = F.when(by_name.isNotNull(), by_name.withField("root_path", shown("start.folder")))
    return asked.join(met, "path", "left").select("path", F.when(near, by_mark).otherwise(placed).cast(FOUND).alias("found"))


def looked_up(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows (cwd string, paths array) with ``places``: (path, found) of the folder, then of each path, in order.

    Each different pair of folder and paths is worked out once; a list is as long as one row's paths.
    """
    key = F.sha2(F.to_json(F.struct("cwd", "paths")), 256)
    asked = rows.select(key.alias("__key"), "cwd", "paths").dropDuplicates(["__key"])
    each = asked.select("__key", F.posexplode(F.concat(F.array("cwd"), F.coalesce("paths", F.array().cast("array<string>")))).alias("pos", "path"))
    each = each.join(resolve(each, folders(files)), "path", "left")
    lists = each.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("pos", "path", "found"))).alias("places"))
    return rows.withColumn("__key", key).join(lists, "__key", "left").drop("__key")


def by_names(cwd: Column, paths: Column) -> Column:
    """The same places by names alone, inside the row."""
    return F.transform(F.concat(F.array(cwd), paths), lambda p: F.struct(p.alias("path"), found_by_name(p).cast(FOUND).alias("found")))


def identity(explicit: str | None, payload_key: Column, cwd: Column, places: Column, from_cwd: bool) -> Column:
    """(project_key, root_path, source, confidence, warnings): explicit, the payload's, the folder's, a mentioned path's, or none.

    With ``from_cwd`` a folder in a marked project decides; one that only has a name gives way to mentioned paths below it.
    """
    def out(key: Column, root: Column, source: Column, sure: Column, warnings: Column) -> Column:
        named = {"project_key": key, "root_path": root, "source": source, "confidence": sure, "warnings": warnings.cast("array<string>")}
        return F.struct(*[value.alias(name) for name, value in named.items()])

    told = lambda key, source: out(key, cwd, F.lit(source), F.lit("high"), F.array())
    of = lambda x, source, *warnings: out(x["project_key"], x["root_path"], F.concat(F.lit(f"{source}:"), x["by"]), x["confidence"], F.array(*warnings))
    none = lambda *warnings: out(F.lit(FALLBACK), F.lit(None).cast("string"), F.lit("fallback"), F.lit("low"), F.array(*map(F.lit, warnings)))
    if explicit:
        return told(F.lit(explicit), "explicit")
    said = F.filter(F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), lambda p: p["found"].isNotNull())
    anywhere = F.get(said, 0)["found"]
    free = F.when(anywhere.isNotNull(), of(anywhere, "mentioned_path")).otherwise(none())
    if from_cwd:
        here, unsure = F.get(places, 0)["found"], "cwd_did_not_resolve_to_project"
        inside = F.get(F.filter(said, lambda p: below(p["path"], cwd)), 0)["found"]
        other = F.exists(said, lambda p: p["found"]["project_key"] != here["project_key"])
        sure = of(here, "cwd").withField("warnings", F.when(other, F.array(F.lit("mentioned_path_ignored_due_to_cwd_project"))).otherwise(F.array().cast("array<string>")))
        by_cwd = F.when(here["confidence"] != "low", sure).when(is_technical(cwd), none("technical_cwd_ignored"))
        by_cwd = by_cwd.when(inside.isNotNull(), of(inside, "mentioned_path", F.lit(unsure))).when(here.isNotNull(), of(here, "cwd", F.lit(unsure)))
        free = F.when(F.coalesce(cwd, F.lit("")) != "", by_cwd.otherwise(none(unsure))).otherwise(free)
    return F.when(payload_key.isNotNull(), told(payload_key, "payload_project_key")).otherwise(free)
