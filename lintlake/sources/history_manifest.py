"""A stored history that can be kept up while it is read: a manifest names its live parts.

``parts/<id>/event_date=...`` hold the rows, each part written once and never changed;
``manifest/<version>.json`` lists, one (part, date) a line, what a version consists of.  A change writes
its part first and then the next version, which exists from one moment to the next or not at all:
it is renamed into place, and the rename fails if another writer was first, who is
then taken into account.  A reader keeps the version it started with, whose files stay until ``vacuum``.

The manifest is small: a line per part and date, and ``compact`` makes one part of all.  Only it is read by the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.times import wall_clock
from lintlake.operators.history import expire, latest_per_key
from lintlake.schemas import HISTORY, HISTORY_COLUMNS
from lintlake.sources.history_store import MAX_RECORDS_PER_FILE

# A live piece of the history: rows of one date in one part, who wrote them and in which batch.
Entry = dict[str, str | int]
_STORED = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in HISTORY.fields) + ", _batch_id bigint, _writer string, event_date date"
_ATTEMPTS = 20


def _context(spark: SparkSession, location: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(location)
    return jvm, jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, location: str) -> list[int]:
    """The versions there are, oldest first."""
    jvm, files = _context(spark, location)
    folder = jvm.org.apache.hadoop.fs.Path(f"{location}/manifest")
    if not files.util().exists(folder):
        return []
    names = [status.getPath().getName() for status in files.util().listStatus(folder)]
    return sorted(int(name[:-5]) for name in names if name.endswith(".json") and not name.startswith(("_", ".")))


def entries(spark: SparkSession, location: str, version: int | None = None) -> tuple[int, list[Entry]]:
    """(version, entries) of a version, by default the newest; version 0 is the empty history."""
    found = versions(spark, location)
    version = (found[-1] if found else 0) if version is None else version
    if not version:
        return 0, []
    lines = spark.read.text(f"{location}/manifest/{version:012d}.json").collect()
    return version, [json.loads(line.value) for line in lines if line.value]


def _publish(spark: SparkSession, location: str, version: int, live: list[Entry]) -> bool:
    """Puts a version into place; False if somebody else was first."""
    jvm, files = _context(spark, location)
    hadoop = jvm.org.apache.hadoop.fs
    final = hadoop.Path(f"{location}/manifest/{version:012d}.json")
    draft = hadoop.Path(f"{location}/manifest/_draft-{uuid.uuid4().hex}")
    gateway = spark.sparkContext._gateway
    flags = jvm.java.util.EnumSet.of(hadoop.CreateFlag.CREATE, hadoop.CreateFlag.OVERWRITE)
    parent = hadoop.Options.CreateOpts.createParent()
    options = gateway.new_array(hadoop.Options.CreateOpts, 1)
    options[0] = parent
    stream = files.create(draft, flags, options)
    stream.write(bytearray("\n".join(json.dumps(entry, sort_keys=True) for entry in live).encode()))
    stream.close()
    try:
        files.rename(draft, final, gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Py4JJavaError as error:
        if not files.util().exists(final):
            raise
        files.delete(draft, False)
        if "FileAlreadyExists" not in str(error.java_exception):
            raise
        return False
    return True


def _change(spark: SparkSession, location: str, change: Callable[[list[Entry]], list[Entry]]) -> int:
    """Publishes ``change`` of the newest version, anew if somebody else was faster."""
    for _ in range(_ATTEMPTS):
        version, live = entries(spark, location)
        if _publish(spark, location, version + 1, change(live)):
            return version + 1
    raise RuntimeError(f"{location} changes too fast: gave up after {_ATTEMPTS} attempts")


def _write_part(rows: DataFrame, location: str, writer: str, batch_id: int) -> list[Entry]:
    """Writes rows (with _batch_id and _writer) as one part, a few files a date, and lists its dates."""
    part = uuid.uuid4().hex
    place = f"{location}/parts/{part}"
    dated = rows.withColumn("event_date", F.to_date("timestamp")).hint("rebalance", F.col("event_date"))
    laid = dated.sortWithinPartitions("event_date", "project_hash", "timestamp")
    laid.write.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).partitionBy("event_date").parquet(place)
    jvm, files = _context(rows.sparkSession, location)
    names = [status.getPath().getName() for status in files.util().listStatus(jvm.org.apache.hadoop.fs.Path(place))]
    dates = sorted(name.split("=", 1)[1] for name in names if name.startswith("event_date="))
    return [{"part": part, "event_date": day, "writer": writer, "batch_id": batch_id} for day in dates]


def append(batch: DataFrame, location: str, batch_id: int, writer: str, tie_break: tuple[str, ...] = ()) -> int:
    """Adds one batch of one writer and returns the new version; the same batch again replaces itself."""
    merged = latest_per_key(batch.select(*HISTORY_COLUMNS, *tie_break), *tie_break).select(HISTORY_COLUMNS)
    own = {"writer": writer, "batch_id": batch_id}
    added = _write_part(merged.withColumns({"_batch_id": F.lit(batch_id).cast("long"), "_writer": F.lit(writer)}), location, writer, batch_id)
    return _change(batch.sparkSession, location, lambda live: [e for e in live if not own.items() <= e.items()] + added)


def _rows(spark: SparkSession, location: str, live: list[Entry], newer_than: datetime | None) -> DataFrame:
    wanted = [e for e in live if newer_than is None or date.fromisoformat(e["event_date"]) >= newer_than.date()]
    if not wanted:
        return spark.createDataFrame([], _STORED).drop("event_date")
    by_part: dict[str, list[str]] = {}
    for entry in wanted:
        by_part.setdefault(entry["part"], []).append(f"{location}/parts/{entry['part']}/event_date={entry['event_date']}")
    folders = [folder for group in by_part.values() for folder in group]
    return spark.read.schema(_STORED.rsplit(", ", 1)[0]).parquet(*folders)


def read(spark: SparkSession, location: str, newer_than: datetime | None = None, version: int | None = None) -> DataFrame:
    """Current rows of a version, by default the newest; only dates that may hold rows ``newer_than`` are opened."""
    log = _rows(spark, location, entries(spark, location, version)[1], newer_than)
    if newer_than is not None:
        log = log.filter(F.col("timestamp") > wall_clock(newer_than))
    return latest_per_key(log, "_batch_id", "_writer").drop("_batch_id", "_writer")


def compact(spark: SparkSession, location: str, as_of: datetime | None = None, days: int = 90) -> int:
    """One part with one row per key in place of all parts there are; with ``as_of``, without expired rows.

    What others add meanwhile stays beside it.  A row keeps the batch and the writer it came from, which still decide against later rows
    of the same time.
    """
    _, old = entries(spark, location)
    replaced = {(e["part"], e["event_date"]) for e in old}
    rows = _rows(spark, location, old, as_of - timedelta(days=days + 1) if as_of else None)
    current = latest_per_key(rows, "_batch_id", "_writer")
    if as_of:
        current = expire(current, as_of, days)
    added = _write_part(current, location, "compaction", -1)
    return _change(spark, location, lambda live: added + [e for e in live if (e["part"], e["event_date"]) not in replaced])


def expire_dates(spark: SparkSession, location: str, as_of: datetime, days: int = 90) -> int:
    """Drops the dates that lie wholly before ``days`` before ``as_of``; no row is read or written.

    Rows of the day in between go with the next ``compact``, and a look-back never shows them.
    """
    first = (as_of - timedelta(days=days)).date()
    return _change(spark, location, lambda live: [e for e in live if date.fromisoformat(e["event_date"]) >= first])


def vacuum(spark: SparkSession, location: str, keep_versions: int = 5) -> int:
    """Deletes the parts that none of the newest versions names; returns how many.  Run it while nobody appends."""
    found = versions(spark, location)[-keep_versions:]
    live = {e["part"] for version in found for e in entries(spark, location, version)[1]}
    jvm, files = _context(spark, location)
    folder = jvm.org.apache.hadoop.fs.Path(f"{location}/parts")
    dead = [status.getPath() for status in files.util().listStatus(folder) if status.getPath().getName() not in live]
    for path in dead:
        files.delete(path, True)
    return len(dead)


def n_files(spark: SparkSession, location: str, version: int | None = None) -> int:
    """How many data files a reader of a version opens."""
    jvm, files = _context(spark, location)
    total = 0
    for entry in entries(spark, location, version)[1]:
        folder = jvm.org.apache.hadoop.fs.Path(f"{location}/parts/{entry['part']}/event_date={entry['event_date']}")
        total += sum(status.getPath().getName().endswith(".parquet") for status in files.util().listStatus(folder))
    return total
