"""Event streams: progress, cost, finding and log events kept as running state.

Every aggregation here is written once as a DataFrame function and works on a batch as well as
on a stream, so a batch over the same events is the check for the stream. Upserts go through
``foreachBatch`` into versioned Parquet, which makes a replayed batch harmless.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditloom.functions.text import severity_rank
from auditloom.operators import ordered
from auditloom.sources.state import _file_system, exists

ENVELOPE = "seq BIGINT, ts TIMESTAMP, run STRING, event STRING, payload STRING"
PAYLOADS = {
    "progress": ("agent STRING, status STRING, durationMs BIGINT, tokensUsed BIGINT, costUsd DECIMAL(18,6), "
                 "findings BIGINT, currentFile STRING, error STRING"),
    "log": "agent STRING, line STRING",
    "finding": "agent STRING, count BIGINT",
    "cost": "agent STRING, tokensUsed BIGINT, costUsd DECIMAL(18,6)",
    "done": "phase STRING",
}
PROGRESS_FIELDS = ["status", "durationMs", "tokensUsed", "costUsd", "findings", "currentFile", "error"]
LOG_TAIL = 201


def event_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Events from a folder of JSON lines as a stream of envelopes."""
    reader = spark.readStream.schema(ENVELOPE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def of_type(events: DataFrame, event: str) -> DataFrame:
    """Events of one type with their payload as columns; a payload that is no JSON is left out."""
    if event not in PAYLOADS:
        raise ValueError(f"unknown event type: {event}")
    parsed = events.filter(F.col("event") == event).withColumn("__p", F.from_json("payload", PAYLOADS[event]))
    return parsed.filter("__p IS NOT NULL").select("seq", "ts", "run", "__p.*")


# --- state as DataFrame functions ----------------------------------------------------------------

def latest_progress(updates: DataFrame, run: str = "run", seq: str = "seq",
                    fields: list[str] = PROGRESS_FIELDS) -> DataFrame:
    """One row per agent: the last non-null value of every field, as if updates were merged in order."""
    present = [name for name in fields if name in updates.columns]
    return updates.groupBy(run, "agent").agg(*[
        F.max_by(name, F.when(F.col(name).isNotNull(), F.col(seq))).alias(name) for name in present
    ], F.max(seq).alias(seq))


def running_totals(costs: DataFrame, run: str = "run") -> DataFrame:
    return costs.groupBy(run).agg(
        F.sum(F.coalesce("tokensUsed", F.lit(0))).alias("total_tokens"),
        F.sum(F.coalesce("costUsd", F.lit(0).cast("decimal(18,6)"))).alias("total_cost"))


def running_cost(costs: DataFrame, run: str = "run", seq: str = "seq", width: int = ordered.WIDTH) -> DataFrame:
    """Totals after every single event."""
    return ordered.running_sum(costs, [run], seq, {
        "total_tokens": F.coalesce("tokensUsed", F.lit(0)),
        "total_cost": F.coalesce("costUsd", F.lit(0).cast("decimal(18,6)"))}, width)


def finding_counts(events: DataFrame, run: str = "run") -> DataFrame:
    """Findings added per agent; events that added none do not count."""
    return events.filter(F.col("count") > 0).groupBy(run, "agent").agg(F.sum("count").alias("findings"))


def split_log_lines(events: DataFrame, text: str = "line") -> DataFrame:
    """Chunks of output as their non-blank lines; ``part`` keeps their order within the chunk."""
    others = [name for name in events.columns if name != text]
    return events.select(*others, F.posexplode(F.split(text, "\n")).alias("part", text)).filter(F.trim(text) != "")


def log_tail(events: DataFrame, run: str = "run", seq: str = "seq", n: int = LOG_TAIL) -> DataFrame:
    """The last 201 log rows of every run."""
    order = [F.desc(name) for name in (seq, "part") if name in events.columns]
    return ordered.top_n(events, [run], order, n, seq)


def budget_alerts(totals: DataFrame, budget: int) -> DataFrame:
    """Runs at 80 % of the token budget or more, with the text of the warning."""
    percent = F.round(F.col("total_tokens") / budget * 100).cast("long")
    return totals.filter(F.col("total_tokens") >= budget * 0.8).withColumn(
        "warning", F.concat(F.lit("Token usage at "), percent.cast("string"), F.lit("% of budget")))


def rate_breaches(events: DataFrame, limit: int = 600, window: str = "60 seconds", run: str | Column = "run",
                  ts: str = "ts", watermark: str = "2 minutes") -> DataFrame:
    """Windows with more events than the limit. On a stream, an event that is later than the watermark is lost to its window."""
    if events.isStreaming:
        events = events.withWatermark(ts, watermark)
    counts = events.groupBy(F.window(ts, window).alias("w"), run).agg(F.count(F.lit(1)).alias("events"))
    return counts.filter(F.col("events") > limit).select(
        run, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events")


# --- upserts -------------------------------------------------------------------------------------

class VersionedTable:
    """A Parquet table replaced as a whole by numbered versions; the newest complete one counts.

    A version is a stream's batch number on top of the version its checkpoint began at, so a batch that is
    replayed after a failure rewrites its own version and reads the one before it, and a stream with a fresh checkpoint goes on
    from the state it finds.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> list[int]:
        if not exists(self.spark, self.root):
            return []
        path, fs = _file_system(self.spark, self.root)
        names = [status.getPath().getName() for status in fs.listStatus(path)]
        found = [int(name[2:]) for name in names if name.startswith("v=")]
        return sorted(v for v in found if exists(self.spark, f"{self.root}/v={v}/_SUCCESS"))

    def base(self, checkpoint: str) -> int:
        """The version at which the stream of this checkpoint began; a checkpoint that does not exist yet begins now."""
        mark = f"{self.root}/_bases/{hashlib.md5(checkpoint.encode()).hexdigest()}"
        path, fs = _file_system(self.spark, mark)
        if exists(self.spark, checkpoint) and fs.exists(path):
            return int(fs.listStatus(path)[0].getPath().getName())
        number = max(self._versions(), default=-1) + 1
        fs.delete(path, True)
        started, _ = _file_system(self.spark, f"{mark}/{number}")
        fs.mkdirs(started)
        return number

    def read(self, before: int | None = None) -> DataFrame | None:
        versions = [v for v in self._versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.root}/v={versions[-1]}") if versions else None

    def write(self, df: DataFrame, version: int, keep: int = 3) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/v={version}")
        for old in self._versions()[:-keep]:
            self._delete(f"v={old}")

    def _delete(self, name: str) -> None:
        path, fs = _file_system(self.spark, f"{self.root}/{name}")
        fs.delete(path, True)

    def update(self, rows: DataFrame, version: int, fold) -> None:
        """Fold new rows into the state: ``fold`` takes old and new rows together."""
        before = self.read(version)
        self.write(fold(rows if before is None else before.unionByName(rows)), version)


class KeyedTable(VersionedTable):
    """A versioned table in hash parts of its keys, of which a batch reads and rewrites those it touches and no others.

    A version's folder holds the parts it wrote; the table is the newest of every part. Parts that ``keep`` later versions
    replaced are deleted. The number of parts belongs to the table and must not change.
    """

    PART = "__part"

    def __init__(self, spark: SparkSession, root: str, keys: list[str], parts: int = 64):
        super().__init__(spark, root)
        self.keys, self.parts = keys, parts

    def _held(self, before: int | None = None) -> dict[int, list[int]]:
        """The versions of each part, oldest first."""
        held: dict[int, list[int]] = {}
        for version in self._versions():
            if before is None or version < before:
                path, fs = _file_system(self.spark, f"{self.root}/v={version}")
                for status in fs.listStatus(path):
                    name = status.getPath().getName()
                    if name.startswith(f"{self.PART}="):
                        held.setdefault(int(name.split("=")[1]), []).append(version)
        return held

    def read(self, before: int | None = None, parts: list[int] | None = None) -> DataFrame | None:
        held = self._held(before)
        paths = [f"{self.root}/v={versions[-1]}/{self.PART}={part}" for part, versions in sorted(held.items()) if parts is None or part in parts]
        return self.spark.read.parquet(*paths) if paths else None

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.PART, F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int"))

    def update(self, rows: DataFrame, version: int, fold) -> None:
        rows = rows.persist()
        try:
            touched = [r[0] for r in self._placed(rows).select(self.PART).distinct().collect()]  # at most ``parts`` numbers
            before = self.read(version, touched)
            self.write(fold(rows if before is None else before.unionByName(rows)), version)
        finally:
            rows.unpersist()

    def write(self, df: DataFrame, version: int, keep: int = 3) -> None:
        self._placed(df).repartition(self.PART).write.mode("overwrite").partitionBy(self.PART).parquet(f"{self.root}/v={version}")
        for part, versions in self._held().items():
            for old in versions[:-keep]:
                self._delete(f"v={old}/{self.PART}={part}")
        used = {version for versions in self._held().values() for version in versions}
        for old in self._versions()[:-keep]:
            if old not in used:
                self._delete(f"v={old}")


def _start(stream: DataFrame, handler, checkpoint: str, table: VersionedTable) -> StreamingQuery:
    base = table.base(checkpoint)
    return stream.writeStream.foreachBatch(lambda batch, number: handler(batch, base + number)).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def keep_progress(stream: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Keep the merged progress row of every agent. A ``KeyedTable`` over run and agent rewrites only the parts a batch touches."""
    return _start(stream, lambda batch, number: table.update(latest_progress(batch), number, latest_progress), checkpoint, table)


def dedup_state(findings: DataFrame, repo: str = "repo", key: str = "dedupKey", seq: str = "seq") -> DataFrame:
    """One row per key as an aggregation: highest severity, earliest among equals, in its first ``slot``.

    On a stream the state store holds one row per key, spread by hash, and update mode emits only
    keys a batch changed. Rows without a key stand for themselves.
    """
    place = F.coalesce(F.when(F.col(key) != "", F.concat(F.lit("k:"), F.col(key))),
                       F.concat(F.lit("#"), F.col(seq).cast("string")))
    order = F.struct(severity_rank("severity"), F.col(seq))
    return findings.withColumn("place", place).groupBy(repo, "place").agg(
        F.min_by(F.struct(*[name for name in findings.columns if name != repo]), order).alias("__row"),
        F.min(seq).alias("slot")).select(repo, "place", "slot", "__row.*")


#: Batch folders of a change log from which they are folded into one.
COMPACT_AFTER = 16


def finding_changes(findings: DataFrame, repo: str = "repo", key: str = "dedupKey", seq: str = "seq") -> DataFrame:
    """``dedup_state`` of a stream whose keyless rows pass by the state store, which so holds one row per key and nothing else."""
    others = [name for name in findings.columns if name != repo]
    has_key = F.coalesce(F.col(key), F.lit("")) != ""
    alone = findings.filter(~has_key).select(repo, F.concat(F.lit("#"), F.col(seq).cast("string")).alias("place"), F.col(seq).alias("slot"), *others)
    return dedup_state(findings.filter(has_key), repo, key, seq).union(alone)


def _log_parts(spark: SparkSession, root: str) -> tuple[int | None, list[int]]:
    """The newest complete base of a change log and the batches after it."""
    path, fs = _file_system(spark, root)
    found: dict[str, list[int]] = {"base": [], "batch": []}
    for status in fs.listStatus(path):
        kind, _, number = status.getPath().getName().partition("=")
        if kind in found and exists(spark, f"{root}/{kind}={number}/_SUCCESS"):
            found[kind].append(int(number))
    base = max(found["base"], default=None)
    return base, sorted(n for n in found["batch"] if base is None or n > base)


def _log(spark: SparkSession, root: str) -> DataFrame:
    base, batches = _log_parts(spark, root)
    parts = [spark.read.parquet(f"{root}/base={base}")] if base is not None else []
    parts += [spark.read.parquet(f"{root}/batch={n}").withColumn("batch", F.lit(n).cast("long")) for n in batches]
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part)
    return log


def _newest(log: DataFrame, repo: str) -> DataFrame:
    names = [name for name in log.columns if name not in (repo, "place")]
    return log.groupBy(repo, "place").agg(F.max_by(F.struct(*names), "batch").alias("__row")).select(repo, "place", "__row.*")


def compact_log(spark: SparkSession, root: str, repo: str = "repo") -> None:
    """Fold a change log's base and batches into a new base, so that its files stay bounded.

    What the base before this one had replaced is deleted now: readers that began with it have had a whole round to finish.
    """
    base, batches = _log_parts(spark, root)
    if not batches:
        return
    _newest(_log(spark, root), repo).write.mode("overwrite").parquet(f"{root}/base={batches[-1]}")
    path, fs = _file_system(spark, root)
    for status in fs.listStatus(path):
        kind, _, number = status.getPath().getName().partition("=")
        if base is not None and ((kind == "batch" and int(number) <= base) or (kind == "base" and int(number) < base)):
            fs.delete(status.getPath(), True)


def keep_findings(stream: DataFrame, root: str, checkpoint: str, compact_after: int = COMPACT_AFTER) -> StreamingQuery:
    """Append each batch's changed keys and keyless rows to a change log; a replayed batch rewrites its own folder.

    Before a batch is written, the batches before it are folded into a base once there are ``compact_after`` of them.
    """
    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if exists(spark, root):
            _, batches = _log_parts(spark, root)
            if len([n for n in batches if n < number]) >= compact_after and batches[-1] < number:
                compact_log(spark, root)
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return finding_changes(stream).writeStream.outputMode("update").foreachBatch(append).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_findings(spark: SparkSession, root: str, repo: str = "repo") -> DataFrame:
    """The findings a change log adds up to: the newest row of every key."""
    return _newest(_log(spark, root), repo).drop("place", "batch")


def keep_log_tail(stream: DataFrame, table: VersionedTable, checkpoint: str, n: int = LOG_TAIL) -> StreamingQuery:
    """Keep the last rows of every run's log, by run in a ``KeyedTable``."""
    return _start(stream, lambda batch, number: table.update(split_log_lines(batch), number, lambda rows: log_tail(rows, n=n)), checkpoint, table)


def keep_alerts(stream: DataFrame, table: VersionedTable, budget: int, checkpoint: str) -> StreamingQuery:
    """Keep running totals per run; ``budget_alerts`` over the table gives the runs to warn about."""
    def marked(totals: DataFrame) -> DataFrame:
        return totals.withColumn("total_cost", F.col("total_cost").cast("decimal(28,6)")).withColumn("alert", F.col("total_tokens") >= budget * 0.8)

    def fold(rows: DataFrame) -> DataFrame:
        return marked(rows.groupBy("run").agg(F.sum("total_tokens").alias("total_tokens"), F.sum("total_cost").alias("total_cost")))

    return _start(stream, lambda batch, number: table.update(marked(running_totals(batch)), number, fold), checkpoint, table)


def to_memory(aggregate: DataFrame, mode: str = "complete") -> tuple[StreamingQuery, str]:
    """Start a streaming aggregate into a named in-memory table, for tests and small dashboards."""
    name = f"stream_{uuid.uuid4().hex[:8]}"
    query = aggregate.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    return query, name
