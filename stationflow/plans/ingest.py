"""From validated payloads to status and station rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow import schemas as S
from stationflow.functions.measures import preferred_text
from stationflow.operators.contract import conform
from stationflow.operators.lookup import preview
from stationflow.session import settle
from stationflow.sources import feeds as G


class FeedError(ValueError):
    """A landed cycle cannot be used."""


# --- vehicle types -----------------------------------------------------------


def split_by_propulsion(
    entries: Column, known: Column, electric: Column
) -> tuple[Column, Column]:
    """Electric and human-powered counts of one station's per-type list.

    A null list gives nulls, an empty one zeros; unknown types count as neither.
    """

    def total(keep) -> Column:
        chosen = F.filter(entries, keep)
        return F.aggregate(
            chosen, F.lit(0).cast("bigint"), lambda acc, e: acc + e["count"].cast("bigint")
        )

    return (
        total(lambda e: F.array_contains(electric, e["vehicle_type_id"])),
        total(
            lambda e: F.array_contains(known, e["vehicle_type_id"])
            & ~F.array_contains(electric, e["vehicle_type_id"])
        ),
    )


# --- records -----------------------------------------------------------------


def _typed(feed: str) -> dict[str, Column]:
    """The columns that later steps read of a feed's records."""
    if feed == G.SYSTEM_INFORMATION:
        return {"system_id": F.col("item.system_id")}
    if feed == G.VEHICLE_TYPES:
        types = F.col("body.data.vehicle_types")
        first = F.coalesce(F.col("pos"), F.lit(0)) == 0
        return {
            **{c: F.col(f"item.{c}") for c in ("vehicle_type_id", "form_factor", "propulsion_type")},
            "name": preferred_text(F.col(G.texts_column("name"))),
            "known_types": F.when(first, F.transform(types, lambda t: t["vehicle_type_id"])),
            "electric_types": F.when(first, F.transform(
                F.filter(types, lambda t: t["propulsion_type"].isin(*S.ELECTRIC_PROPULSION)),
                lambda t: t["vehicle_type_id"],
            )),
        }
    if feed == G.STATION_INFORMATION:
        return {
            "station_id": F.col("item.station_id"),
            "station_name": preferred_text(F.col(G.texts_column("name"))),
            "address": F.col("item.address"),
            "lat": F.expr(G.real("item.lat")),
            "lon": F.expr(G.real("item.lon")),
            "capacity": F.expr(G.whole("item.capacity")),
            "is_charging_station": F.expr(G.flag("item.is_charging_station")),
        }
    if feed == G.STATION_STATUS:
        entries = G.nested("item.vehicle_types_available", G.TYPE_COUNTS)
        counts = ("num_vehicles_available", "num_vehicles_disabled", "num_docks_available",
                  "num_docks_disabled")
        return {
            "station_id": F.col("item.station_id"),
            **{c: F.expr(G.whole(f"item.{c}")) for c in counts},
            **{c: F.expr(G.flag(f"item.{c}")) for c in ("is_installed", "is_renting", "is_returning")},
            "types_available": F.expr(
                f"transform({entries}, e -> named_struct("
                f"'vehicle_type_id', e.vehicle_type_id, 'count', {G.whole('e.`count`')}))"
            ),
        }
    return {}


@dataclass(frozen=True)
class Landed:
    """Landed payloads, each parsed and checked once: a table of typed records per feed.

    ``feeds`` are the cycles' feeds as they landed, one row per payload. Every later step reads these
    tables, pruned to its columns, and none reads the payloads again.
    """

    feeds: DataFrame
    tables: dict[str, DataFrame]

    def rows(self, feed: str) -> DataFrame:
        """One row per payload of a feed: its first."""
        return self.tables[feed].where(F.coalesce(F.col("pos"), F.lit(0)) == 0)

    def records(self, feed: str) -> DataFrame:
        return self.tables[feed].where(F.col("pos").isNotNull())

    def settled(self, folder: str | None = None) -> Landed:
        """Every table written once, in columns, for the reads that follow."""
        return Landed(
            settle(self.feeds, folder),
            {feed: settle(table, folder) for feed, table in self.tables.items()},
        )

    def without(self, cycles: DataFrame) -> Landed:
        """The cycles that are not among ``cycles``."""
        def kept(df: DataFrame) -> DataFrame:
            return df.join(cycles, "cycle_id", "left_anti")

        return Landed(kept(self.feeds), {feed: kept(table) for feed, table in self.tables.items()})


def landed(payloads: DataFrame | Landed) -> Landed:
    """Payloads as tables of records; nothing is computed yet."""
    if isinstance(payloads, Landed):
        return payloads
    tables = {feed: G.records(payloads, feed, **_typed(feed)) for feed in G.CYCLE_FEEDS}
    return Landed(payloads.select("cycle_id", "observed_at", "feed"), tables)


# --- rows --------------------------------------------------------------------


def vehicle_types(payloads: DataFrame | Landed) -> DataFrame:
    """Vehicle types of every cycle."""
    return landed(payloads).records(G.VEHICLE_TYPES).select(
        "cycle_id", "vehicle_type_id", "form_factor", "propulsion_type", "name"
    )


def _systems(held: Landed) -> DataFrame:
    return held.rows(G.SYSTEM_INFORMATION).select("cycle_id", "system_id")


def _cycle_context(held: Landed) -> DataFrame:
    """One row per cycle: system and the type ids its own payload lists."""
    per_cycle = held.rows(G.VEHICLE_TYPES).select("cycle_id", "known_types", "electric_types")
    return _systems(held).join(per_cycle, "cycle_id")


def station_rows(payloads: DataFrame | Landed) -> DataFrame:
    """One ``stations`` row per station_information record, keyed by cycle."""
    held = landed(payloads)
    rows = held.records(G.STATION_INFORMATION).join(_systems(held), "cycle_id")
    return rows.select("cycle_id", *S.STATIONS_SCHEMA.fieldNames())


def status_rows(payloads: DataFrame | Landed) -> DataFrame:
    """One ``station_status`` row per station_status record, keyed by cycle."""
    held = landed(payloads)
    rows = held.records(G.STATION_STATUS).join(_cycle_context(held), "cycle_id")
    electric, human = split_by_propulsion(
        F.col("types_available"), F.col("known_types"), F.col("electric_types")
    )
    return rows.withColumns(
        {"num_vehicles_electric": electric, "num_vehicles_human": human}
    ).select("cycle_id", *S.STATUS_SCHEMA.fieldNames())


# --- checks across feeds -----------------------------------------------------


def reference_violations(payloads: DataFrame | Landed) -> DataFrame:
    """Status records that name stations or vehicle types their cycle does not describe.

    The types of an unknown station are not looked at.
    """
    held = landed(payloads)
    described = (
        held.records(G.STATION_INFORMATION)
        .select("cycle_id", "station_id")
        .distinct()
        .withColumn("described", F.lit(True))
    )
    status = held.records(G.STATION_STATUS).select(
        "cycle_id", "pos", "station_id", F.expr("types_available.vehicle_type_id").alias("used")
    )
    checked = status.join(_cycle_context(held), "cycle_id", "left").join(
        described, ["cycle_id", "station_id"], "left"
    )
    unknown = "coalesce(array_except(used, coalesce(known_types, array())), array())"
    findings = f"""CASE WHEN described IS NULL
        THEN array(named_struct(
            'path', 'station_id', 'rule', 'unknown_station', 'value', station_id))
        ELSE transform({unknown}, t -> named_struct(
            'path', 'vehicle_types_available.vehicle_type_id', 'rule', 'unknown_vehicle_type',
            'value', t)) END"""
    return checked.select(
        "cycle_id",
        F.lit(G.STATION_STATUS).alias("feed"),
        F.col("pos").cast("int").alias("pos"),
        F.inline(F.expr(findings)),
    )


def validate(payloads: DataFrame | Landed) -> DataFrame:
    """All violations of the landed cycles, before records are compared across feeds."""
    held = landed(payloads)
    parts = [G.violations_of(table, feed) for feed, table in held.tables.items()]
    return reduce(DataFrame.unionByName, [*parts, G.missing_feeds(held.feeds)])


def cycle_violations(payloads: DataFrame | Landed, folder: str | None = None) -> DataFrame:
    """Everything wrong with the landed cycles.

    Records are compared across feeds only in cycles whose feeds are all valid. Payloads are parsed
    once, into tables (in ``folder``, if given); the violations are few and read again and again, so
    they are computed once and kept too.
    """
    held = payloads if isinstance(payloads, Landed) else landed(payloads).settled(folder)
    broken = settle(validate(held), folder)
    valid = held.without(broken.select("cycle_id").distinct())
    return broken.unionByName(settle(reference_violations(valid), folder))


def domain_violations(rows: DataFrame, table: str) -> DataFrame:
    """Flattened rows that break a table's own limits (counts, coordinates)."""
    numbers = [f.name for f in S.TABLE_SCHEMAS[table] if f.dataType.typeName() == "long"]
    bad = {c: F.col(c) < 0 for c in numbers}
    if table == S.STATIONS:
        bad["lat"] = F.coalesce(~F.col("lat").between(-90, 90), F.lit(True))
        bad["lon"] = F.coalesce(~F.col("lon").between(-180, 180), F.lit(True))
    else:
        bad["num_vehicles_available"] = ~F.coalesce(
            F.col("num_vehicles_available") >= 0, F.lit(False)
        )
    found = F.array_compact(F.array(*[F.when(cond, F.lit(c)) for c, cond in bad.items()]))
    return rows.select(*S.IDENTITY, F.explode(found).alias("path"))


# --- whole cycles ------------------------------------------------------------


@dataclass(frozen=True)
class Cycles:
    """Rows of the clean cycles, and what is wrong with the others."""

    status: DataFrame
    stations: DataFrame
    violations: DataFrame


def flatten_cycles(
    payloads: DataFrame | Landed, violations: DataFrame | None = None, folder: str | None = None
) -> Cycles:
    """Rows of every clean cycle. A cycle with any violation contributes no rows at all."""
    held = payloads if isinstance(payloads, Landed) else landed(payloads).settled(folder)
    if violations is None:
        violations = cycle_violations(held, folder)
    clean = held.without(violations.select("cycle_id").distinct())
    return Cycles(
        status=conform(status_rows(clean), S.STATION_STATUS),
        stations=conform(station_rows(clean), S.STATIONS),
        violations=violations,
    )


def violation_preview(violations: DataFrame, size: int = 5) -> DataFrame:
    """First offending values per cycle and rule; of unknown vehicle types, distinct ones.

    A station that several records name is listed as often, as the records are.
    """
    found = violations.where(F.col("value").isNotNull())
    types = F.col("rule") == "unknown_vehicle_type"
    by = ["cycle_id", "rule"]
    return preview(found.where(types), "value", by=by, size=size, distinct=True).unionByName(
        preview(found.where(~types), "value", by=by, size=size)
    )


def require_clean(violations: DataFrame) -> None:
    """Raise on the first violations, for callers that want a failure instead of a table."""
    found = violations.orderBy("cycle_id", "feed", "rule", "value").limit(5).collect()
    if found:
        listed = "; ".join(f"{v.cycle_id} {v.feed} {v.rule} {v.path} {v.value}" for v in found)
        raise FeedError(f"landed cycles break their contract: {listed}")


def matched_stations(payloads: DataFrame | Landed) -> DataFrame:
    """Per cycle: station ids that both feeds name."""
    held = landed(payloads)
    sides = [
        held.records(feed).select("cycle_id", "station_id")
        for feed in (G.STATION_INFORMATION, G.STATION_STATUS)
    ]
    return sides[0].intersect(sides[1]).groupBy("cycle_id").agg(
        F.count("*").alias("matched_station_status_count")
    )


def ingestion_summary(payloads: DataFrame | Landed, folder: str | None = None) -> DataFrame:
    """One row per cycle: feed times, distinct stations, statuses, matches, rows."""
    held = payloads if isinstance(payloads, Landed) else landed(payloads).settled(folder)

    def feed_time(feed: str, name: str) -> DataFrame:
        return held.rows(feed).select("cycle_id", F.col("updated").alias(name))

    def tally(feed: str, distinct: str, rows: str | None = None) -> DataFrame:
        ids = held.records(feed).groupBy("cycle_id", "station_id").count()
        measures = [F.count("*").alias(distinct)]
        if rows:
            measures.append(F.sum("count").alias(rows))
        return ids.groupBy("cycle_id").agg(*measures)

    parts = (
        feed_time(G.STATION_INFORMATION, "station_information_last_updated"),
        feed_time(G.STATION_STATUS, "station_status_last_updated"),
        tally(G.STATION_INFORMATION, "station_count"),
        tally(G.STATION_STATUS, "status_count", "processed_station_status_count"),
        matched_stations(held),
    )
    summary = _systems(held)
    for part in parts:
        summary = summary.join(part, "cycle_id", "left")
    counts = [c for c in summary.columns if c.endswith("_count")]
    return summary.fillna(0, subset=counts)
