"""An append-only Parquet store: keyed inserts that ignore what is there, latest-wins reads, tombstones.

Every table is partitioned by a bucket of its project, so what asks for one project reads one bucket of it.

A batch of events goes into several tables. Each is keyed and filled from the stored turns of the batch, not from
what a call has just inserted, and a marker is written last. So a replay after a failure, whichever table it came
at, completes what is missing and gives the store that no failure would have given; a whole batch is skipped. One
writer at a time is assumed; readers may come and go.

Buckets with many small files are merged: rows are rewritten in the table's order without those removed, beside a list
of old and new files, so that a merge that is interrupted is completed when the store is opened next.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from continuo.functions import folding as fd
from continuo.functions.text import iso_seconds
from continuo.operators.search import posting_rows, search_words
from continuo.operators.state import turn_observations
from continuo.plans.schemas import DEFAULTS, ENVELOPE, ENVELOPE_MORE, TABLES, columns
from continuo.plans.session import steady

#: Partitions of a table; part of its layout.
BUCKETS = 64
SESSION, TURN = ("project_key", "runtime", "session_id"), ("project_key", "runtime", "session_id", "turn_id")
#: Metadata that names the model, the capturing version, and the project's root.
MODEL_KEYS = ("model_name", "model", "model-name", "llm_model")
VERSION_KEYS = ("producer_version", "server_version", "package_version")
SCHEMA_VERSION = "capture_schema_version"
#: Files of a bucket that are merged once there are more; what a merge sorts by; keys of rows that have been removed.
MOST_FILES = 64
SORTED = {"postings": ("term",), "observations": ("project_key", "updated_at"), "turns": ("project_key", "captured_at")}
REMOVED = ("project_key", "id", "batch")


def bucket_of(project_key: str) -> int:
    return zlib.crc32(project_key.encode()) % BUCKETS


def bucket(project_key: Column) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(project_key, F.lit("")), "UTF-8")), F.lit(BUCKETS)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, base: str, read_only: bool = False):
        self.spark, self.base, self.read_only = steady(spark), base.rstrip("/"), read_only
        if not read_only:
            self.recover()

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def views(self) -> None:
        """Registers every table as a temporary view of its name."""
        for name in TABLES:
            self.read(name).createOrReplaceTempView(name)

    def _raw(self, table: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{TABLES[table]}, bucket int").parquet(self.path(table))
        except Exception as e:  # a table that nobody has written yet is empty
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"{TABLES[table]}, bucket int")

    def read(self, table: str, project_key: str | None = None) -> DataFrame:
        """A table's rows, of one project's bucket only if a project is given. Columns that a file lacks are null or default."""
        rows = self._raw(table)
        if project_key is not None:
            rows = rows.where((F.col("bucket") == bucket_of(project_key)) & (F.col("project_key") == project_key))
        for name, value in DEFAULTS.get(table, {}).items():
            rows = rows.withColumn(name, F.coalesce(name, F.lit(value)))
        if set(REMOVED) <= set(columns(table)) and table != "removals":
            rows = self._left(rows, project_key)
        return rows.drop("bucket")

    def _left(self, rows: DataFrame, project_key: str | None = None) -> DataFrame:
        """Rows that no removal names; without removals the plan has no join."""
        gone = self._raw("removals")
        gone = gone if project_key is None else gone.where(F.col("bucket") == bucket_of(project_key))
        return rows.join(gone.select("bucket", *REMOVED).distinct(), ["bucket", *REMOVED], "left_anti")

    def _writable(self, table: str) -> None:
        if self.read_only:
            raise PermissionError(f"{table}: the store is read-only")

    def append(self, table: str, rows: DataFrame, touched: list[int] | None = None) -> None:
        """Written as one file a bucket where it is small; the runtime splits a large one."""
        self._writable(table)
        if "seq" in columns(table):
            rows = self._sequenced(table, rows, touched)
        dealt = rows.select(*columns(table)).withColumn("bucket", bucket(F.col("project_key"))).hint("rebalance", "bucket")
        if table in SORTED:
            dealt = dealt.sortWithinPartitions("bucket", *SORTED[table])  # a reader of few terms skips the other row groups
        dealt.write.mode("append").partitionBy("bucket").parquet(self.path(table))

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(bucket(F.col("project_key"))).distinct().collect()]  # BUCKETS at most

    def _of(self, table: str, touched: list[int]) -> DataFrame:
        return self._raw(table).where(F.col("bucket").isin(touched))

    def rows_of(self, table: str, touched: list[int]) -> DataFrame:
        """The rows of some buckets that no removal names."""
        return self._left(self._of(table, touched)).drop("bucket")

    def _sequenced(self, table: str, rows: DataFrame, touched: list[int] | None) -> DataFrame:
        """Rows with the number after the project's last one in this table."""
        held = self._of(table, self._touched(rows) if touched is None else touched)
        last = held.groupBy(F.col("project_key").alias("of")).agg(F.max("seq").alias("last"))
        out = rows.drop("seq").join(last, F.col("project_key").eqNullSafe(F.col("of")), "left")
        return out.withColumn("seq", F.coalesce("last", F.lit(0)).cast("long") + 1).drop("of", "last")

    def insert_or_ignore(self, table: str, rows: DataFrame, keys: tuple[str, ...], order: str, batch: str | None = None, touched: list[int] | None = None) -> None:
        """Appends of each key the first row, if the table has none that is left. Keys may be null.

        keys hold project_key; only the buckets of the rows' projects are compared.
        """
        touched = self._touched(rows) if touched is None else touched
        held = self._of(table, touched)
        if set(REMOVED) <= set(columns(table)):
            held = self._left(held)
        held = held.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        rows = rows if batch is None else rows.withColumn("batch", F.lit(batch))
        rows = rows.select(*[c for c in columns(table) if c != "seq"])
        first = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__rn = 1").drop("__rn")
        met = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        self.append(table, first.join(held, met, "left_anti"), touched)

    def latest(self, table: str, keys: tuple[str, ...], project_key: str | None = None) -> DataFrame:
        """The newest row of each key; a newest row with ``deleted`` hides its key.

        Rows of one time go by their number, those that older versions wrote without one by their contents.
        """
        rows = self.read(table, project_key)
        numbered = [F.desc_nulls_last("seq")] if "seq" in rows.columns else []
        newest = Window.partitionBy(*keys).orderBy(F.desc("at"), *numbered, F.xxhash64(*rows.columns))
        out = rows.withColumn("__rn", F.row_number().over(newest)).where("__rn = 1").drop("__rn")
        return out.where(~F.coalesce(F.col("deleted"), F.lit(False))) if "deleted" in out.columns else out

    # -- ingest

    def ingest(self, events: DataFrame, batch: str | None = None, then: Callable[[DataFrame, list[int]], None] | None = None) -> DataFrame:
        """Turns (first payload wins), what their texts hold, its provenance and index, projects and sessions seen.

        Null keys and times count as empty texts, so that replayed rows meet what is stored. ``batch`` names the events,
        by default by their contents; ``then`` takes the batch's turns and their buckets before the batch is marked
        as whole. Gives the turns of batches that were not whole before.
        """
        self._writable("turns")
        events = envelope(events)
        batch = batch or self._name_of(events)
        if self._whole().where(F.col("batch") == batch).head(1):
            return self._raw("turns").drop("bucket").where("false")
        touched = self._touched(events)
        self.insert_or_ignore("turns", events, TURN, "captured_at", batch, touched)
        keys = events.select(*TURN).distinct()
        turns = self._of("turns", touched).join(keys, list(TURN), "left_semi").join(self._whole(), "batch", "left_anti")
        found = turn_observations(turns, *TURN, "captured_at")
        content = F.sha2(F.concat_ws("|", *TURN, "type", "title", "summary", "detail"), 256)
        none = F.array().cast("array<string>")
        found = found.withColumns({"dedupe_hash": content, "source_kind": F.lit("turn_extract"), "updated_at": F.col("captured_at"), "files": none})
        self.insert_or_ignore("observations", found.withColumn("id", F.xxhash64("dedupe_hash")), ("project_key", "dedupe_hash"), "updated_at", batch, touched)
        stored = self._left(self._of("observations", touched)).join(turns.select(*TURN), list(TURN), "left_semi").where("source_kind = 'turn_extract'")
        root = F.coalesce(said("project_root_path"), F.nullif(F.trim("cwd"), F.lit("")))
        seen = events.select("project_key", root.alias("root_path"), F.col("captured_at").alias("seen_at"))
        visits = events.select(*SESSION, "cwd", "metadata", F.col("captured_at").alias("seen_at"), F.sha2(F.to_json(F.struct("cwd", "metadata")), 256).alias("entry"))
        steps = [partial(self.insert_or_ignore, "projects", seen, ("project_key", "root_path", "seen_at"), "root_path", touched=touched)]
        steps += [partial(self.insert_or_ignore, "sessions", visits, (*SESSION, "seen_at", "entry"), "seen_at", touched=touched)]
        steps += self._derived(stored, touched, turns)
        together(steps if then is None else [partial(then, turns.drop("bucket"), touched), *steps])
        self.finish(batch)
        self.tidy(touched)
        return self._of("turns", touched).where(F.col("batch") == batch).drop("bucket")

    @staticmethod
    def _name_of(events: DataFrame) -> str:
        """A name that equal events give."""
        parts = [F.to_json(F.struct(c)) if kind.startswith(("map", "array")) else F.col(c) for c, kind in sorted(events.dtypes)]
        one = events.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*parts).cast("decimal(38,0)")).alias("h")).first()
        return f"{one.n}:{one.h or 0}"

    def _whole(self) -> DataFrame:
        """The names of the batches that all tables have; a row a call, so it is small beside what the calls wrote."""
        return self.read("batches", "").select("batch")

    def finish(self, batch: str) -> None:
        """Marks a batch as whole."""
        self.append("batches", self.spark.createDataFrame([("", batch, 0)], TABLES["batches"]), [bucket_of("")])

    def add_observations(self, rows: DataFrame) -> DataFrame:
        """New observations that no turn made, with their provenance and their words in the index."""
        batch, touched = uuid.uuid4().hex, self._touched(rows)
        self.insert_or_ignore("observations", rows, ("project_key", "dedupe_hash"), "updated_at", batch, touched)
        keys = rows.select("project_key", "dedupe_hash").distinct()
        stored = self._left(self._of("observations", touched)).join(keys, ["project_key", "dedupe_hash"], "left_semi").join(self._whole(), "batch", "left_anti")
        together(self._derived(stored, touched))
        self.finish(batch)
        return self._of("observations", touched).where(F.col("batch") == batch).drop("bucket")

    def _derived(self, stored: DataFrame, touched: list[int], turns: DataFrame | None = None) -> list[Callable[[], None]]:
        """What inserts provenance, index and word counts of stored observations, where they lack. turns: those that rows come from."""
        none = {c: F.lit(None).cast("string") for c in ("turn_hash", "model_name", "cwd")}
        from_turns = None if turns is None else turns.select(*TURN, F.col("content_hash").alias("turn_hash"), "model_name", "cwd")
        source = stored.withColumns(none) if from_turns is None else stored.join(from_turns, list(TURN), "left")
        span = F.to_json(F.struct("files", F.col("type").alias("observation_type"), "source_kind", "title")).alias("source_span")
        source = source.select(F.lit("observation").alias("memory_kind"), F.col("id").cast("string").alias("memory_id"), *TURN, F.col("id").alias("observation_id"), *none, span, F.col("updated_at").alias("at"))
        batches = stored.select("batch").distinct()
        counts = word_counts(self._of("observations", touched).join(batches, "batch", "left_semi"))
        parts = (("provenance", source, ("project_key", "memory_kind", "memory_id"), "at"), ("postings", posting_rows(stored, "batch"), (*REMOVED, "term"), "dl"), ("index_stats", counts, ("project_key", "batch"), "rows"))
        return [partial(self.insert_or_ignore, *part, touched=touched) for part in parts]

    def remove_observations(self, project_key: str, ids: list[int], now: int) -> None:
        """Takes observations, their words and word counts away; what comes again later is a new row."""
        rows = self.read("observations", project_key).where(F.col("id").isin(ids))
        gone = local_rows(rows.select(*columns("observations")))
        less = word_counts(gone).withColumns({"rows": -F.col("rows"), "words": -F.col("words"), "batch": F.lit(uuid.uuid4().hex)})
        self.append("index_stats", less, [bucket_of(project_key)])
        self.append("removals", gone.select(*REMOVED, F.lit(now).cast("long").alias("at")), [bucket_of(project_key)])

    # -- files

    def _files(self):
        """Hadoop's path class and the file system of the store."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.base).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def revision(self, project_key: str) -> str:
        """A name of the state of the project's buckets, which every writer's next write changes; no table is read."""
        path, files = self._files()
        parts = []
        for table in sorted(TABLES):
            at = path(f"{self.path(table)}/bucket={bucket_of(project_key)}")
            if table != "heartbeats" and files.exists(at):
                whole = files.getContentSummary(at)
                parts.append((table, whole.getFileCount(), whole.getLength(), files.getFileStatus(at).getModificationTime()))
        return hashlib.sha256(json.dumps(parts).encode()).hexdigest()

    def tidy(self, touched: list[int]) -> None:
        """Merges the buckets that have come to hold more than MOST_FILES files."""
        path, files = self._files()
        for table in TABLES:
            dirs = {b: path(f"{self.path(table)}/bucket={b}") for b in touched}
            many = [b for b, at in dirs.items() if files.exists(at) and files.getContentSummary(at).getFileCount() > MOST_FILES]
            if many:
                self.merge(table, many)

    def merge(self, table: str, buckets: list[int]) -> None:
        """Rewrites buckets of a table as few sorted files, without removed rows; word counts of whole batches are summed.

        The new files are written aside, then listed beside the old ones, then moved in, then the old ones go.
        A reader that has listed the old files must list again if it is that slow.
        """
        self._writable(table)
        path, files = self._files()
        dirs = [f"{self.path(table)}/bucket={b}" for b in buckets]
        held = {d: [x.getPath().getName() for x in files.listStatus(path(d)) if x.getPath().getName().startswith("part-")] for d in dirs}
        old = [f"{d}/{name}" for d, names in held.items() for name in names]
        rows = self.spark.read.schema(f"{TABLES[table]}, bucket int").option("basePath", self.path(table)).parquet(*old)
        if set(REMOVED) <= set(columns(table)):
            rows = self._left(rows)
        if table == "index_stats":
            rows = rows.join(self._whole().withColumn("whole", F.lit(True)), "batch", "left")
            kept = F.when(F.col("whole").isNull(), F.col("batch")).alias("batch")  # a batch that isn't whole may come again
            rows = rows.groupBy("bucket", "project_key", kept).agg(F.sum("rows").alias("rows"), F.sum("words").alias("words"))
        aside = f"{self.base}/_merged-{uuid.uuid4().hex}"
        dealt = rows.select(*columns(table), "bucket").hint("rebalance", "bucket")
        dealt.sortWithinPartitions("bucket", *SORTED.get(table, ())).write.partitionBy("bucket").parquet(aside)
        new = []
        for b in buckets:
            at = path(f"{aside}/bucket={b}")
            if files.exists(at):
                new += [[x.getPath().toString(), f"{self.path(table)}/bucket={b}/{x.getPath().getName()}"] for x in files.listStatus(at) if x.getPath().getName().startswith("part-")]
        out = files.create(path(f"{aside}.json"), True)
        out.write(bytearray(json.dumps({"new": new, "old": old, "aside": aside}).encode()))
        out.close()
        self.recover()

    def recover(self) -> None:
        """Completes merges that have listed their files; what else lies aside is of merges that never came so far."""
        path, files = self._files()
        if not files.exists(path(self.base)):
            return
        names = [x.getPath().getName() for x in files.listStatus(path(self.base))]
        for name in names:
            if name.startswith("_merged-") and name.endswith(".json"):
                stream = files.open(path(f"{self.base}/{name}"))  # Spark's readers skip such names
                listed = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                stream.close()
                for source, target in listed["new"]:
                    if files.exists(path(source)):
                        files.rename(path(source), path(target))
                for gone in [*listed["old"], listed["aside"], f"{self.base}/{name}"]:
                    files.delete(path(gone), True)
        for name in names:
            if name.startswith("_merged-") and not name.endswith(".json") and f"{name}.json" not in names:
                files.delete(path(f"{self.base}/{name}"), True)

    # -- what is stored

    def observations(self, project_key: str | None = None) -> DataFrame:
        return self.read("observations", project_key)

    def decisions(self, project_key: str | None = None) -> DataFrame:
        """A decision a row: those that observations made; the observation's id is the decision's."""
        rows = self.observations(project_key).where("type = 'decision'")
        return rows.select("id", "project_key", "runtime", "session_id", "title", F.col("summary").alias("decision_text"), "status", "updated_at")

    def projects(self, project_key: str | None = None) -> DataFrame:
        """project_key, name, root_path, updated_at. The first root that is not blank sticks; its newest spelling shows."""
        seen = self.read("projects", project_key).withColumn("root_key", fd.path_key(F.col("root_path")))
        first = seen.where("root_key <> ''").groupBy("project_key").agg(F.min(F.struct("seen_at", "root_key")).alias("x")).select("project_key", F.col("x.root_key").alias("root_key"))
        roots = seen.join(first, ["project_key", "root_key"]).groupBy("project_key").agg(F.max(F.struct("seen_at", "root_path")).alias("x")).select("project_key", "x.root_path")
        name = F.trim(F.translate("project_key", "-_", "  "))
        names = F.coalesce(F.nullif(name, F.lit("")), F.col("project_key"))
        return seen.groupBy("project_key").agg(F.max("seen_at").alias("updated_at")).join(roots, "project_key", "left").select("project_key", names.alias("name"), "root_path", "updated_at")

    def sessions(self, project_key: str | None = None) -> DataFrame:
        """project_key, runtime, session_id, cwd (the newest that is not null), metadata, started_at, last_seen, root_path, root_match, warning.

        Metadata is merged by key: the newest value that is not blank; the first producer version is kept beside the last,
        and the capture schema is the highest seen. A folder outside the root that the metadata names doesn't match.
        """
        seen = self.read("sessions", project_key)
        newest = F.max(F.when(F.col("cwd").isNotNull(), F.struct("seen_at", "cwd")))
        times = seen.groupBy(*SESSION).agg(newest.alias("x"), F.min("seen_at").alias("started_at"), F.max("seen_at").alias("last_seen")).select(*SESSION, F.col("x.cwd").alias("cwd"), "started_at", "last_seen")
        each = seen.select(*SESSION, "seen_at", F.explode("metadata").alias("name", "value")).where("trim(value) <> ''")
        folded = each.groupBy(*SESSION, "name").agg(F.max(F.struct("seen_at", "value")).alias("last"), F.min(F.struct("seen_at", "value")).alias("first"), F.max(F.expr("try_cast(value as long)")).alias("most"))
        version = F.when(F.col("name") == SCHEMA_VERSION, F.greatest(F.lit(1), F.coalesce("most", F.lit(1))).cast("string")).otherwise(F.col("last.value"))
        entries = F.array(F.struct(F.col("name").alias("key"), version.alias("value")))
        firsts = F.array(F.struct(F.lit("producer_version_first_seen").alias("key"), F.col("first.value").alias("value")))
        entries = F.when(F.col("name") == "producer_version", F.concat(entries, firsts)).otherwise(entries)
        merged = folded.where("name <> 'producer_version_first_seen'").groupBy(*SESSION).agg(F.map_from_entries(F.flatten(F.collect_list(entries))).alias("metadata"))
        out = times.join(merged, list(SESSION), "left").withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
        root = said("project_root_path")
        out = out.withColumns({"root_path": root, "root_match": root.isNull() | fd.within(F.col("cwd"), root)})
        wrong = F.when(F.startswith(F.coalesce(said("project_resolution_source"), F.lit("")), F.lit("mentioned_path")), "mentioned_path_capture_cwd_outside_project_root").otherwise("session_cwd_outside_project_root")
        version = F.coalesce(*[said(k) for k in VERSION_KEYS])
        return out.withColumns({"warning": F.when(~F.col("root_match"), wrong), "producer_version": version})


def together(steps: list[Callable[[], None]]) -> None:
    """Runs steps that don't wait for each other at the same time; the first failure is raised once all have ended."""
    with ThreadPoolExecutor(len(steps)) as pool:
        for done in [pool.submit(step) for step in steps]:
            done.result()


def word_counts(observations: DataFrame) -> DataFrame:
    """(project_key, batch, rows, words): what ranks need of all rows."""
    sizes = [F.size(search_words(F.col(c))) for c in ("title", "summary", "detail")]
    words = F.sum(sizes[0] + sizes[1] + sizes[2]).cast("long").alias("words")
    return observations.groupBy("project_key", "batch").agg(F.count("*").alias("rows"), words)


def local_rows(rows: DataFrame) -> DataFrame:
    """The few rows that somebody named, as a table of the driver."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def said(name: str) -> Column:
    """A value of the column ``metadata``, null if it is blank."""
    return F.nullif(F.trim(F.col("metadata")[name]), F.lit(""))


def envelope(events: DataFrame) -> DataFrame:
    """Events with all columns of a turn; payloads that nobody kept are the event as JSON."""
    have = {c.lower() for c in events.columns}
    missing = [part.split(" ", 1) for part in ENVELOPE_MORE.split(", ") if part.split()[0] not in have]
    events = events.withColumns({name: F.lit(None).cast(kind) for name, kind in missing})
    events = events.withColumns({k: F.coalesce(k, F.lit("")) for k in (*TURN, "timestamp")})
    own = sorted(part.split()[0] for part in ENVELOPE.split(", "))
    payload = F.coalesce("raw_payload", F.to_json(F.struct(*own)))
    at = F.coalesce(iso_seconds(F.col("timestamp")), F.lit(0)).cast("long")
    model = F.coalesce(*[said(k) for k in MODEL_KEYS])
    return events.withColumns({"raw_payload": payload, "content_hash": F.sha2(payload, 256), "captured_at": at, "model_name": model})
