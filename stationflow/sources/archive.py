"""The day archive: days are written under a version, audited, and published by one manifest.

A table's folder holds ``_versions/version=<id>/date=<day>/`` and ``_manifests/<number>.json``. The
manifest of the highest number names, for every day, the version that holds it and what the audit
measured there. Writers never touch a published folder: they write a version of their own, read it
back, compare it with what they meant to write, and then put the next manifest in place, which either
appears whole or not at all. Until then, and after any failure, readers see the days as they were.

Days that lie directly under the folder (``date=<day>/``) were written before there were manifests;
they count until a version replaces them.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow import schemas as S
from stationflow.functions.clock import utc_day
from stationflow.sources import storage

#: Manifests that stay readable when older ones are cleaned away.
KEPT_MANIFESTS = 2

Audit = Callable[[DataFrame], list[str]]


class AuditError(RuntimeError):
    """What was stored is not what was to be written; nothing was published."""


class ConflictError(RuntimeError):
    """Another writer published one of the same days first; nothing was published."""


@dataclass(frozen=True)
class Day:
    """A published day. Times are epoch microseconds; an unversioned day was never measured."""

    version: str | None
    rows: int | None = None
    oldest: int | None = None
    newest: int | None = None
    checksum: str | None = None


@dataclass(frozen=True)
class Manifest:
    number: int
    days: dict[dt.date, Day]

    def to_text(self) -> str:
        days = {day.isoformat(): asdict(entry) for day, entry in sorted(self.days.items())}
        return json.dumps({"number": self.number, "days": days}, indent=1)

    @staticmethod
    def from_text(text: str) -> Manifest:
        held = json.loads(text)
        days = {dt.date.fromisoformat(day): Day(**entry) for day, entry in held["days"].items()}
        return Manifest(held["number"], days)


# --- manifests ---------------------------------------------------------------


def _manifest_path(path: str, number: int) -> str:
    return f"{path}/_manifests/{number:012d}.json"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    names = storage.children(spark, f"{path}/_manifests")
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def has_manifest(spark: SparkSession, path: str) -> bool:
    return bool(_numbers(spark, path))


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    """The newest manifest; before the first one, number 0 with the unversioned days."""
    while True:
        numbers = _numbers(spark, path)
        if not numbers:
            return Manifest(0, {day: Day(None) for day in storage.partition_days(spark, path)})
        text = storage.read_text(spark, _manifest_path(path, numbers[-1]))
        if text is not None:  # else it was cleaned away after newer ones came
            return Manifest.from_text(text)


def commit(spark: SparkSession, path: str, base: Manifest, days: dict[dt.date, Day]) -> Manifest:
    """Publish days on top of the newest manifest; ``base`` is the one they were decided on.

    Writers of other days in between are kept. A day that somebody else changed since ``base`` is a
    conflict: nothing is published and the caller may start again from the new state.
    """
    while True:
        latest = read_manifest(spark, path)
        changed = sorted(day for day in days if latest.days.get(day) != base.days.get(day))
        if changed:
            raise ConflictError(f"{path}: {', '.join(map(str, changed))} published by another writer")
        following = Manifest(latest.number + 1, {**latest.days, **days})
        if storage.put_new(spark, _manifest_path(path, following.number), following.to_text()):
            return following


def manifest_rows(spark: SparkSession, path: str) -> DataFrame:
    """Published days as rows: ``day, version, rows, oldest, newest``; no data file is read."""
    rows = [
        (day, e.version, e.rows, e.oldest, e.newest) for day, e in read_manifest(spark, path).days.items()
    ]
    found = spark.createDataFrame(
        rows, "day date, version string, rows bigint, oldest bigint, newest bigint"
    )
    return found.withColumns({c: F.timestamp_micros(c) for c in ("oldest", "newest")})


# --- reading -----------------------------------------------------------------


def scan(spark: SparkSession, path: str, table: str, *also: Column) -> DataFrame:
    """Rows of the published days, with ``version`` and ``date`` from their folders.

    ``also`` are further columns of the files, such as parts of ``_metadata``.
    """
    manifest, schema = read_manifest(spark, path), S.TABLE_SCHEMAS[table]
    parts = []
    versioned = [
        f"{path}/_versions/version={e.version}/date={day.isoformat()}"
        for day, e in sorted(manifest.days.items()) if e.version is not None
    ]
    typed = T.StructType([*schema, T.StructField("version", T.StringType()), T.StructField("date", T.DateType())])
    if versioned:
        reader = spark.read.schema(typed).option("basePath", f"{path}/_versions")
        parts.append(reader.parquet(*versioned).select("*", *also))
    plain = [
        f"{path}/date={day.isoformat()}"
        for day, e in sorted(manifest.days.items()) if e.version is None
    ]
    if plain:
        old = T.StructType([*schema, T.StructField("date", T.DateType())])
        reader = spark.read.schema(old).option("basePath", path)
        unversioned = reader.parquet(*plain).select("*", *also)
        parts.append(unversioned.withColumn("version", F.lit(None).cast("string")))
    if not parts:
        return spark.createDataFrame([], typed)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The published rows under the declared schema, with ``date``; one state for all its reads."""
    return scan(spark, path, table).select(*S.TABLE_SCHEMAS[table].fieldNames(), "date")


# --- write, audit, publish ---------------------------------------------------


def _measures(columns: Sequence[str]) -> list:
    hashed = F.xxhash64(*[F.col(c) for c in columns]).cast("decimal(20,0)")
    return [
        F.count(F.lit(1)).alias("rows"),
        F.min(F.unix_micros("observed_at")).alias("oldest"),
        F.max(F.unix_micros("observed_at")).alias("newest"),
        F.coalesce(F.sum(hashed), F.lit(0)).cast("string").alias("checksum"),
    ]


def _problems(stored: list, wanted: dict) -> list[str]:
    """Differences between what is stored, day by day, and what was to be written."""
    found = {
        "rows": sum(r["rows"] for r in stored),
        "oldest": min((r["oldest"] for r in stored), default=None),
        "newest": max((r["newest"] for r in stored), default=None),
        "checksum": str(sum(int(r["checksum"]) for r in stored)),
        "days": sorted(r["date"] for r in stored),
    }
    problems = [
        f"{name}: stored {found[name]}, expected {wanted[name]}"
        for name in found if found[name] != wanted[name]
    ]
    problems += [f"{r['date']}: {r['misplaced']} rows of other days" for r in stored if r["misplaced"]]
    return problems


def publish_days(
    df: DataFrame, path: str, table: str, audits: Sequence[Audit] = ()
) -> dict[dt.date, int]:
    """Write whole days, audit what is stored, and publish them; rows per day.

    The audit reads the stored days back: rows, bounds and a checksum over all columns must be those
    of ``df``, and every row must lie in its own day. ``audits`` see the stored rows and return
    problems of their own. With any problem nothing is published, the new files go, and the days stay
    as they were. A day without rows is not written. Publishing a day again replaces it.
    """
    from stationflow.sources.sinks import write_parquet

    spark, base = df.sparkSession, read_manifest(df.sparkSession, path)
    columns = [*S.TABLE_SCHEMAS[table].fieldNames(), "date"]
    dated = df.withColumn("date", utc_day("observed_at")).select(*columns)
    measures = [*_measures(columns), F.sort_array(F.collect_set("date")).alias("days")]
    version = uuid.uuid4().hex
    target = f"{path}/_versions/version={version}"
    held = Observation()
    try:
        write_parquet(dated.observe(held, *measures), target, ("date",))
        wanted = held.get
        if not wanted["rows"]:
            storage.delete(spark, target)
            return {}
        typed = T.StructType([*S.TABLE_SCHEMAS[table], T.StructField("date", T.DateType())])
        found = spark.read.schema(typed).parquet(target)
        # one row per written day
        stored = found.groupBy("date").agg(
            *_measures(columns), F.count_if(utc_day("observed_at") != F.col("date")).alias("misplaced")
        ).collect()
        problems = _problems(stored, wanted)
        if problems:
            # a task that ran twice is observed twice: count again before calling it damage
            problems = _problems(stored, dated.agg(*measures).head().asDict())
        for audit in audits:
            problems += audit(found)
        if problems:
            raise AuditError(f"{path}: {'; '.join(problems)}")
        days = {
            r["date"]: Day(version, r["rows"], r["oldest"], r["newest"], r["checksum"]) for r in stored
        }
        commit(spark, path, base, days)
    except BaseException:
        storage.delete(spark, target)
        raise
    return {day: entry.rows for day, entry in days.items()}


def adopt(spark: SparkSession, path: str, table: str) -> Manifest:
    """Measure the unversioned days and publish what they hold; their files stay where they are."""
    base = read_manifest(spark, path)
    plain = [day for day, e in base.days.items() if e.version is None and e.rows is None]
    if not plain:
        return base
    columns = [*S.TABLE_SCHEMAS[table].fieldNames(), "date"]
    rows = read(spark, path, table).where(F.col("date").isin(plain))
    measured = {r["date"]: r for r in rows.groupBy("date").agg(*_measures(columns)).collect()}
    days = {
        day: replace(base.days[day], rows=r["rows"], oldest=r["oldest"], newest=r["newest"],
                     checksum=r["checksum"])
        for day, r in measured.items()
    }
    return commit(spark, path, base, days)


def damaged_days(spark: SparkSession, path: str, table: str) -> list[dt.date]:
    """Published days whose stored rows are no longer those that were audited."""
    manifest = read_manifest(spark, path)
    columns = [*S.TABLE_SCHEMAS[table].fieldNames(), "date"]
    rows = read(spark, path, table).groupBy("date").agg(*_measures(columns)).collect()
    stored = {r["date"]: (r["rows"], r["checksum"]) for r in rows}
    return sorted(
        day for day, e in manifest.days.items()
        if e.rows is not None and stored.get(day) != (e.rows, e.checksum)
    )


def clean(spark: SparkSession, path: str, keep: int = KEPT_MANIFESTS) -> int:
    """Drop days that only manifests before the last ``keep`` name, and those; folders dropped.

    Versions no manifest names are left alone: a writer may be at work on them.
    """
    numbers = _numbers(spark, path)
    old, kept = numbers[: -keep or None], numbers[-keep:]

    def named(which: list[int]) -> set[tuple[str | None, dt.date]]:
        texts = [storage.read_text(spark, _manifest_path(path, n)) for n in which]
        return {
            (e.version, day) for t in texts if t for day, e in Manifest.from_text(t).days.items()
        }

    gone = named(old) - named(kept) if old else set()
    for version, day in sorted(gone, key=str):
        folder = f"date={day.isoformat()}"
        place = path if version is None else f"{path}/_versions/version={version}"
        storage.delete(spark, f"{place}/{folder}")
        if version is not None and not any(
            n.startswith("date=") for n in storage.children(spark, place)
        ):
            storage.delete(spark, place)
    for number in old:
        storage.delete(spark, _manifest_path(path, number))
    return len(gone)
