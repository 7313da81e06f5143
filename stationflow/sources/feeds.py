"""Landed feed payloads: reading, typed parsing and validation rules.

A payload row is ``(cycle_id, observed_at, feed, payload)`` with the JSON text of one feed
of one cycle. All scalars are parsed as text first and then cast, so that a value of the
wrong type is told apart from an absent one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow import schemas as S
from stationflow.functions.clock import CYCLE_FORMAT

DISCOVERY = "gbfs"
SYSTEM_INFORMATION = "system_information"
VEHICLE_TYPES = "vehicle_types"
STATION_INFORMATION = "station_information"
STATION_STATUS = "station_status"
CYCLE_FEEDS = (DISCOVERY, SYSTEM_INFORMATION, VEHICLE_TYPES, STATION_INFORMATION, STATION_STATUS)

TEXTS = "array<struct<text string, language string>>"
TYPE_COUNTS = "array<struct<vehicle_type_id string, count string>>"
GROUP_COUNTS = "array<struct<vehicle_type_ids array<string>, count string>>"
AREA = "struct<type string, coordinates array<array<array<array<double>>>>>"


# --- casts of parsed text, as SQL over a column or field name -----------------


def whole(x: str) -> str:
    """Text as an integer; null when it is not one.

    Plain digits, which most are, need no division of decimals.
    """
    digits, number = f"try_cast({x} AS BIGINT)", f"try_cast({x} AS DECIMAL(38, 6))"
    return (
        f"(CASE WHEN CAST({digits} AS STRING) = {x} THEN {digits}"
        f" WHEN {number} % 1 = 0 THEN try_cast({number} AS BIGINT) END)"
    )


def real(x: str) -> str:
    return f"try_cast({x} AS DOUBLE)"


def flag(x: str) -> str:
    return (
        f"(CASE WHEN {x} = 'true' THEN true WHEN {x} = 'false' THEN false"
        f" WHEN lower({x}) IN ('true', 't', 'yes', 'y', 'on', '1') THEN true"
        f" WHEN lower({x}) IN ('false', 'f', 'no', 'n', 'off', '0') THEN false END)"
    )


def moment(x: str) -> str:
    """ISO text or epoch seconds (milliseconds above 2e10) as an instant."""
    epoch = f"try_cast({x} AS DOUBLE)"
    seconds = f"(CASE WHEN abs({epoch}) > 2e10 THEN {epoch} / 1000 ELSE {epoch} END)"
    return (
        f"coalesce(CASE WHEN {x} RLIKE r'^\\s*\\d{{4}}-\\d{{2}}-\\d{{2}}' THEN try_to_timestamp({x}) END,"
        f" timestamp_micros(try_cast({seconds} * 1000000 AS BIGINT)))"
    )


def nested(x: str, ddl: str) -> str:
    """Nested JSON kept as text, parsed; null when absent or of another shape."""
    return f"from_json({x}, '{ddl}')"


def texts_column(path: str) -> str:
    """The column of ``records`` with a record's localized texts, parsed."""
    return f"_texts_{path}"


def kind(x: str) -> str:
    """What a variant holds; VOID is a JSON null."""
    return f"schema_of_variant({x})"


# --- rules -------------------------------------------------------------------

# The fields of a record that should be texts and are not; null where none is.
ODD = "_odd"
LOCALIZED = "localized"


@dataclass(frozen=True)
class Rule:
    """``broken`` gives the SQL that is true for a value that is present and wrong."""

    path: str
    name: str
    broken: Callable[[str], str]
    required: bool = False


def _unless(ok: str) -> str:
    return f"NOT coalesce({ok}, false)"


def _values(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def text_rule(path: str, required: bool = True) -> Rule:
    """A value must be a JSON text; ``parse`` notes the fields of a record that are not."""

    def broken(x: str) -> str:
        return f"array_contains({x.rpartition('.')[0]}.{ODD}, '{path}')"

    return Rule(path, "text", broken, required)


def count_rule(path: str, required: bool = False) -> Rule:
    return Rule(path, "count", lambda x: _unless(f"{whole(x)} >= 0"), required)


def range_rule(path: str, low: float, high: float) -> Rule:
    return Rule(path, "range", lambda x: _unless(f"{real(x)} BETWEEN {low} AND {high}"), True)


def flag_rule(path: str, required: bool = False) -> Rule:
    return Rule(path, "flag", lambda x: f"{flag(x)} IS NULL", required)


def enum_rule(path: str, values: tuple[str, ...], required: bool = False) -> Rule:
    return Rule(path, "enum", lambda x: f"{x} NOT IN ({_values(values)})", required)


def time_rule(path: str) -> Rule:
    return Rule(path, "time", lambda x: f"{moment(x)} IS NULL", True)


def url_rule(path: str) -> Rule:
    web = r"r'^\s*(https?|wss?|ftp):/*[^/?#\s]+\S*\s*$'"
    other = r"r'^\s*(?!https?:|wss?:|ftp:)[A-Za-z][A-Za-z0-9+.\-]*:\S*\s*$'"
    return Rule(path, "url", lambda x: f"NOT ({x} RLIKE {web} OR {x} RLIKE {other})", True)


def _every(x: str, ddl: str, condition: str) -> str:
    """SQL that is true unless every entry ``e`` of a nested list meets a condition."""
    return _unless(f"forall({nested(x, ddl)}, e -> coalesce({condition}, false))")


def texts_rule(path: str, required: bool = False) -> Rule:
    fine = "e.text IS NOT NULL AND e.language IS NOT NULL"
    return Rule(path, LOCALIZED, lambda x: _every(x, TEXTS, fine), required)


def named_rule(path: str) -> Rule:
    """A list of localized texts must hold at least one."""
    return Rule(path, "no_localized_name", lambda x: f"size({nested(x, TEXTS)}) = 0")


def enum_list_rule(path: str, values: tuple[str, ...]) -> Rule:
    return Rule(path, "enum", lambda x: _every(x, "array<string>", f"e IN ({_values(values)})"))


def counts_rule(path: str, ddl: str) -> Rule:
    """A list of entries with an id (or ids) and a count."""
    ids = "vehicle_type_id" if ddl == TYPE_COUNTS else "vehicle_type_ids"
    fine = f"e.{ids} IS NOT NULL AND {whole('e.`count`')} >= 0"
    return Rule(path, "counts", lambda x: _every(x, ddl, fine))


def area_rule(path: str) -> Rule:
    def broken(x: str) -> str:
        shape = nested(x, AREA)
        points = f"flatten(flatten(flatten({shape}.coordinates)))"
        return _unless(
            f"{shape}.type = 'MultiPolygon' AND forall({points}, p -> p IS NOT NULL)"
        )

    return Rule(path, "area", broken)


def uris_rule(path: str) -> Rule:
    """An object of texts."""
    links = "map_values({})".format(nested("{x}", "map<string, variant>"))

    def broken(x: str) -> str:
        return (
            f"json_object_keys({x}) IS NULL OR NOT coalesce("
            f"forall({links.format(x=x)}, e -> e IS NULL OR {kind('e')} IN ('STRING', 'VOID')), false)"
        )

    return Rule(path, "uris", broken)


ENVELOPE_RULES = (
    time_rule("last_updated"),
    count_rule("ttl", required=True),
    enum_rule("version", (S.FEED_VERSION,), required=True),
)


@dataclass(frozen=True)
class Feed:
    """Shape of a feed: the list (or the single record) under ``data``."""

    name: str
    list_field: str | None
    fields: str
    rules: tuple[Rule, ...]

    @property
    def texts(self) -> tuple[str, ...]:
        """Fields whose JSON type matters."""
        return tuple(r.path for r in self.rules if r.name == "text")

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(f.split()[0] for f in self.fields.split(","))

    def _body(self, text: str, *also: str) -> str:
        fields = ", ".join(
            [f"{n} {text if n in self.texts else 'string'}" for n in self.names] + list(also)
        )
        inner = f"{self.list_field} array<struct<{fields}>>" if self.list_field else fields
        return f"last_updated string, ttl string, version string, data struct<{inner}>"

    @property
    def body(self) -> str:
        """All scalars as text. No payload that is read with it holds the field ``ODD``."""
        return self._body("string", f"{ODD} array<string>")

    @property
    def exact_body(self) -> str:
        """The fields whose JSON type matters as variants."""
        return self._body("variant")

    @property
    def suspects(self) -> str | None:
        """Pattern of every payload in which such a field may hold something else than a text.

        A name and a colon, then neither a quote nor the n of null; or a name with an escape.
        """
        if not self.texts:
            return None
        names = "|".join(self.texts)
        # One class begins every match, so that most characters are looked at once.
        named = rf"""(?:{names})["']\s*:\s*[^"'\sn]|{ODD}["']"""
        return rf"""["'\\](?:(?<!\\)(?:{named})|(?<=\\)u[^"']*["']\s*:)"""

    def suspect(self, payload: Column) -> Column:
        """Whether a payload matches ``suspects``.

        Every match holds a backslash, ``ODD`` or a name with its colon. These patterns begin with a
        literal, which is searched for in strides, so that few payloads meet the whole pattern, which
        looks at every character.
        """
        likely = payload.contains("\\") | payload.contains(ODD)
        for name in self.texts:
            likely |= payload.rlike(rf"""{name}["']\s*:\s*[^"'\sn]""")
        return likely & payload.rlike(self.suspects)

    def plain(self, body: str) -> str:
        """SQL of the parsed body with texts as strings, and each record's odd fields noted."""

        def record(e: str) -> str:
            fields, odd = [], []
            for name in self.names:
                x = f"{e}.{name}"
                if name in self.texts:
                    odd.append(f"CASE WHEN {kind(x)} NOT IN ('STRING', 'VOID') THEN '{name}' END")
                    x = (
                        f"CASE {kind(x)} WHEN 'STRING' THEN variant_get({x}, '$', 'string')"
                        f" WHEN 'VOID' THEN NULL ELSE to_json({x}) END"
                    )
                fields.append(f"'{name}', {x}")
            noted = f"array_compact(array({', '.join(odd) or 'CAST(NULL AS STRING)'}))"
            return f"if({e} IS NULL, NULL, named_struct({', '.join(fields)}, '{ODD}', {noted}))"

        if self.list_field is None:
            data = record(f"{body}.data")
        else:
            inner = f"transform({body}.data.{self.list_field}, e -> {record('e')})"
            data = f"if({body}.data IS NULL, NULL, named_struct('{self.list_field}', {inner}))"
        kept = ", ".join(f"'{n}', {body}.{n}" for n in ("last_updated", "ttl", "version"))
        return f"if({body} IS NULL, NULL, named_struct({kept}, 'data', {data}))"


def _text_fields(*names: str) -> str:
    return ", ".join(f"{name} string" for name in names)


FEEDS = {
    f.name: f
    for f in (
        Feed(
            DISCOVERY,
            "feeds",
            _text_fields("name", "url"),
            (enum_rule("name", S.FEED_NAMES, required=True), url_rule("url")),
        ),
        Feed(SYSTEM_INFORMATION, None, _text_fields("system_id"), (text_rule("system_id"),)),
        Feed(
            VEHICLE_TYPES,
            "vehicle_types",
            _text_fields("vehicle_type_id", "form_factor", "propulsion_type", "name"),
            (
                text_rule("vehicle_type_id"),
                enum_rule("form_factor", S.FORM_FACTORS, required=True),
                enum_rule("propulsion_type", S.PROPULSION_TYPES, required=True),
                texts_rule("name"),
            ),
        ),
        Feed(
            STATION_INFORMATION,
            "stations",
            _text_fields(
                "station_id", "name", "lat", "lon", "short_name", "address", "cross_street",
                "region_id", "post_code", "station_opening_hours", "rental_methods",
                "is_virtual_station", "station_area", "parking_type", "parking_hoop",
                "contact_phone", "capacity", "vehicle_types_capacity",
                "vehicle_docks_capacity", "is_valet_station", "is_charging_station",
                "rental_uris",
            ),
            (
                text_rule("station_id"),
                texts_rule("name", required=True),
                named_rule("name"),
                range_rule("lat", -90.0, 90.0),
                range_rule("lon", -180.0, 180.0),
                texts_rule("short_name"),
                *[
                    text_rule(name, required=False)
                    for name in ("address", "cross_street", "region_id", "post_code",
                                 "station_opening_hours", "contact_phone")
                ],
                enum_list_rule("rental_methods", S.RENTAL_METHODS),
                flag_rule("is_virtual_station"),
                area_rule("station_area"),
                enum_rule("parking_type", S.PARKING_TYPES),
                flag_rule("parking_hoop"),
                count_rule("capacity"),
                counts_rule("vehicle_types_capacity", GROUP_COUNTS),
                counts_rule("vehicle_docks_capacity", GROUP_COUNTS),
                flag_rule("is_valet_station"),
                flag_rule("is_charging_station"),
                uris_rule("rental_uris"),
            ),
        ),
        Feed(
            STATION_STATUS,
            "stations",
            _text_fields(
                "station_id", "num_vehicles_available", "vehicle_types_available",
                "num_vehicles_disabled", "num_docks_available", "vehicle_docks_available",
                "num_docks_disabled", "is_installed", "is_renting", "is_returning",
                "last_reported",
            ),
            (
                text_rule("station_id"),
                count_rule("num_vehicles_available", required=True),
                counts_rule("vehicle_types_available", TYPE_COUNTS),
                count_rule("num_vehicles_disabled"),
                count_rule("num_docks_available"),
                counts_rule("vehicle_docks_available", GROUP_COUNTS),
                count_rule("num_docks_disabled"),
                flag_rule("is_installed", required=True),
                flag_rule("is_renting", required=True),
                flag_rule("is_returning", required=True),
                time_rule("last_reported"),
            ),
        ),
    )
}


def rules_table(spark: SparkSession) -> DataFrame:
    """Every rule as a row, for reporting."""
    rows = [
        (feed.name, rule.path, rule.name, rule.required)
        for feed in FEEDS.values()
        for rule in (*ENVELOPE_RULES, *feed.rules)
    ]
    return spark.createDataFrame(rows, "feed string, path string, rule string, required boolean")


# --- reading -----------------------------------------------------------------

BUNDLE_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("cycle_id", "feed", "payload")]
)


def cycle_time(cycle_id: Column) -> Column:
    """A cycle is named by the instant it was observed at."""
    return F.try_to_timestamp(cycle_id, F.lit(CYCLE_FORMAT))


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Payload rows from landed files named ``<cycle>/<feed>.json``."""
    name = F.col("_metadata.file_path")
    cycle = F.regexp_extract(name, r"/([^/]+)/[^/]+\.json$", 1)
    return (
        spark.read.text(
            path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json"
        ).select(
            cycle.alias("cycle_id"),
            cycle_time(cycle).alias("observed_at"),
            F.regexp_extract(name, r"/([^/]+)\.json$", 1).alias("feed"),
            F.col("value").alias("payload"),
        )
    )


# When a line landed: its file's time, then its name.
FILE_ARRIVAL = "struct(_metadata.file_modification_time, _metadata.file_path)"


def from_bundles(lines: DataFrame, arrival: str | None = None) -> DataFrame:
    """Payload rows from bundle lines ``{cycle_id, feed, payload}``.

    ``arrival`` is SQL for a sortable ``arrived`` column, such as ``FILE_ARRIVAL``.
    """
    arrived = [] if arrival is None else [F.expr(arrival).alias("arrived")]
    return lines.select(
        "cycle_id", cycle_time(F.col("cycle_id")).alias("observed_at"), "feed", "payload", *arrived
    )


def last_arrivals(payloads: DataFrame) -> DataFrame:
    """Each cycle's feeds as they landed last; without ``arrived`` nothing can be told apart.

    The payloads themselves are not shuffled to compare arrivals. A feed that one file holds
    twice stays twice, which is a violation.
    """
    if "arrived" not in payloads.columns:
        return payloads
    last = payloads.groupBy("cycle_id", "feed").agg(F.max("arrived").alias("arrived"))
    return payloads.join(last, ["cycle_id", "feed", "arrived"], "left_semi").drop("arrived")


# --- parsing -----------------------------------------------------------------


END_KEY = "_end_of_payload"


def is_json_object(payload: str = "payload") -> Column:
    """Whether a text column is exactly one JSON object.

    Spark's JSON functions stop after the first value. Followed by one more key in an object, the
    keys are that key and the payload's only if nothing is left over. A payload that may hold that
    key itself is read as the only element of a list and as the only value of an object: anything
    left over breaks at least one of the two.
    """
    twice = (
        f"json_array_length(concat('[', {payload}, ']')) = 1"
        f""" AND size(json_object_keys(concat('{{"p":', {payload}, '}}'))) = 1"""
    )
    once = (
        f"""json_object_keys(concat('{{"p":', {payload}, ',"{END_KEY}":0}}'))"""
        f" = array('p', '{END_KEY}')"
    )
    return F.expr(
        f"coalesce({payload} RLIKE r'^\\s*\\{{' AND"
        f" CASE WHEN contains({payload}, r'\\') OR contains({payload}, '{END_KEY}')"
        f" THEN {twice} ELSE {once} END, false)"
    )


def parse(payloads: DataFrame, feed: str) -> DataFrame:
    """Payload rows of one feed with ``is_object`` and the parsed ``body``.

    Only payloads in which a text field may hold another JSON type are read as variants, which tell
    the types apart and cost several times as much.
    """
    spec = FEEDS[feed]
    rows = payloads.where(F.col("feed") == feed)
    kept = ["cycle_id", "observed_at", is_json_object().alias("is_object")]
    plain = F.from_json("payload", spec.body)
    if spec.suspects is None:
        return rows.select(*kept, plain.alias("body"))
    suspect = spec.suspect(F.col("payload"))
    return rows.select(
        *kept,
        F.when(suspect, F.from_json("payload", spec.exact_body)).alias("exact"),
        F.when(~suspect, plain).alias("body"),
    ).select(
        "cycle_id", "observed_at", "is_object",
        F.expr(f"CASE WHEN exact IS NOT NULL THEN {spec.plain('exact')} ELSE body END").alias("body"),
    )


def items(parsed: DataFrame, feed: str) -> DataFrame:
    """One row per record of a parsed feed, with its position."""
    spec = FEEDS[feed]
    if spec.list_field is None:
        return parsed.select("cycle_id", "observed_at", F.lit(0).alias("pos"), F.col("body.data").alias("item"))
    return parsed.select(
        "cycle_id", "observed_at", F.posexplode(f"body.data.{spec.list_field}").alias("pos", "item")
    )


FINDINGS = "array<struct<pos: int, path: string, rule: string, value: string>>"
NO_FINDINGS = f"CAST(array() AS {FINDINGS})"
WHOLE = "CAST(NULL AS INT)"  # the position of a finding about a payload as a whole


def _broken(rules: tuple[Rule, ...], prefix: str, pos: str) -> str:
    """SQL of the array of broken rules of a row; compiled, as it has no lambda."""
    checks = []
    for rule in rules:
        x = f"{prefix}.{rule.path}"
        absent = f"WHEN {x} IS NULL THEN array({_finding(pos, rule.path, 'required')})"
        checks.append(
            f"CASE {absent if rule.required else ''}"
            f" WHEN {x} IS NOT NULL AND ({rule.broken(x)})"
            f" THEN array({_finding(pos, rule.path, rule.name, x)}) ELSE {NO_FINDINGS} END"
        )
    return f"concat({', '.join(checks)})"


def _any_broken(rules: tuple[Rule, ...], prefix: str) -> str:
    """SQL that is true for a row with a broken rule, without listing which.

    Stops at the first, while ``_broken`` builds an array: only rows with findings need that. As
    branches the rules become methods of their own, small enough for the JVM to compile.
    """
    checks = []
    for rule in rules:
        x = f"{prefix}.{rule.path}"
        absent = f"{x} IS NULL OR" if rule.required else f"{x} IS NOT NULL AND"
        checks.append(f"WHEN {absent} ({rule.broken(x)}) THEN true")
    return f"(CASE {' '.join(checks)} ELSE false END)"


def _finding(pos: str, path: str, rule: str, value: str = "CAST(NULL AS STRING)") -> str:
    return f"named_struct('pos', {pos}, 'path', '{path}', 'rule', '{rule}', 'value', {value})"


VIOLATION = ("cycle_id", "feed", "pos", "path", "rule", "value")


def _envelope_findings(spec: Feed) -> str:
    """SQL of the array of findings about a payload as a whole."""

    def finding(path: str, rule: str, *value: str) -> str:
        return _finding(WHOLE, path, rule, *value)

    if spec.list_field is None:
        records = f"CASE WHEN body.data IS NULL THEN array({finding('data', 'required')}) END"
    else:
        path = f"data.{spec.list_field}"
        records = f"CASE WHEN body.{path} IS NULL THEN array({finding(path, 'required')})"
        if spec.name == STATION_STATUS:
            records += f" WHEN size(body.{path}) = 0 THEN array({finding(path, 'no_rows')})"
        if spec.name == DISCOVERY:
            missing = f"array_except(array({_values(CYCLE_FEEDS[1:])}), body.{path}.name)"
            unlisted = f"transform({missing}, f -> {finding(path, 'unlisted_feed', 'f')})"
            records += f" WHEN size({missing}) > 0 THEN {unlisted}"
        records += " END"
    return (
        f"CASE WHEN NOT is_object THEN array({finding('', 'object')}) ELSE"
        f" concat(CASE WHEN {_any_broken(ENVELOPE_RULES, 'body')}"
        f" THEN {_broken(ENVELOPE_RULES, 'body', WHOLE)} ELSE {NO_FINDINGS} END,"
        f" coalesce({records}, {NO_FINDINGS})) END"
    )


def records(payloads: DataFrame, feed: str, **typed: Column) -> DataFrame:
    """One row per record of a feed, parsed once: ``typed`` columns over ``item``, and findings.

    ``cycle_id, observed_at, updated`` (the feed's own time), ``pos`` and ``findings``, an array of
    broken rules. Findings about the payload as a whole have no position and travel with its first
    row; a payload without records has one row, without a position. ``typed`` may also look at
    ``body``, which the first row of a payload holds, and at ``texts_column`` of a localized field.
    """
    spec = FEEDS[feed]
    checked = parse(payloads, feed).select(
        "cycle_id",
        "observed_at",
        F.expr(moment("body.last_updated")).alias("updated"),
        F.expr(_envelope_findings(spec)).alias("_whole"),
        "body",
    )
    # The single record is a list of one: a filter on the findings must stay above the explode, as
    # below it every column would be put into it, and the payload parsed for each of its uses.
    listed = f"body.data.{spec.list_field}" if spec.list_field else (
        "CASE WHEN body.data IS NOT NULL THEN array(body.data) END"
    )
    exploded = checked.select("*", F.posexplode_outer(F.expr(listed)).alias("pos", "item"))
    # Localized texts are parsed once, for the rules and for ``typed``.
    lists = {r.path: texts_column(r.path) for r in spec.rules if r.name == LOCALIZED}
    exploded = exploded.select(
        "*", *[F.expr(nested(f"item.{path}", TEXTS)).alias(name) for path, name in lists.items()]
    )

    def parsed(sql: str) -> str:
        for path, name in lists.items():
            sql = sql.replace(nested(f"item.{path}", TEXTS), name)
        return sql

    has_record = "pos IS NOT NULL" if spec.list_field else "item IS NOT NULL"
    findings = f"""concat(
        CASE WHEN coalesce(pos, 0) = 0 THEN _whole ELSE {NO_FINDINGS} END,
        CASE WHEN {has_record} AND {parsed(_any_broken(spec.rules, 'item'))}
             THEN {parsed(_broken(spec.rules, 'item', 'pos'))} ELSE {NO_FINDINGS} END)"""
    return exploded.select(
        "cycle_id", "observed_at", "updated", "pos",
        *[column.alias(name) for name, column in typed.items()],
        F.expr(findings).alias("findings"),
    )


def violations_of(found: DataFrame, feed: str) -> DataFrame:
    """The findings of records as rows.

    Rows without one are dropped after the explode: a filter on the findings before it would compute
    them a second time, from the payload on.
    """
    return found.select(
        "cycle_id", F.lit(feed).alias("feed"), F.inline_outer("findings")
    ).where(F.col("rule").isNotNull()).select(*VIOLATION)


def feed_violations(payloads: DataFrame, feed: str) -> DataFrame:
    """Broken rules of one feed, one row each; ``pos`` is null for the payload as a whole."""
    return violations_of(records(payloads, feed), feed)


def resolve_feed_urls(payloads: DataFrame) -> DataFrame:
    """Per cycle and wanted feed: the first url the discovery document lists, or null."""
    entries = items(parse(payloads, DISCOVERY), DISCOVERY)
    wanted = F.array(*[F.lit(f) for f in CYCLE_FEEDS[1:]])
    listed = (
        entries.where(F.col("item.name").isin(*CYCLE_FEEDS[1:]))
        .groupBy("cycle_id", F.col("item.name").alias("feed"))
        .agg(F.min_by("item.url", "pos").alias("url"))
    )
    cycles = payloads.where(F.col("feed") == DISCOVERY).select("cycle_id").distinct()
    return cycles.select("cycle_id", F.explode(wanted).alias("feed")).join(
        listed, ["cycle_id", "feed"], "left"
    )


def missing_feeds(payloads: DataFrame) -> DataFrame:
    """Violations for feeds a cycle lacks or holds twice."""
    counted = payloads.groupBy("cycle_id").agg(
        *[F.count_if(F.col("feed") == f).alias(f) for f in CYCLE_FEEDS]
    )
    findings = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f) != 1,
                    F.struct(
                        F.lit(f).alias("feed"),
                        F.when(F.col(f) == 0, "missing_feed").otherwise("repeated_feed").alias("rule"),
                    ),
                )
                for f in CYCLE_FEEDS
            ]
        )
    )
    return counted.select("cycle_id", F.inline(findings)).select(
        "cycle_id",
        "feed",
        F.lit(None).cast("int").alias("pos"),
        F.lit("").alias("path"),
        "rule",
        F.lit(None).cast("string").alias("value"),
    )


def feed_verdicts(payloads: DataFrame) -> DataFrame:
    """Per cycle and feed: whether the payload is valid.

    The records of a feed tell its cycles too, so every payload is read once.
    """
    checked = [
        records(payloads, f).select("cycle_id", F.lit(f).alias("feed"), F.size("findings").alias("n"))
        for f in CYCLE_FEEDS
    ]
    without_rules = payloads.where(F.coalesce(~F.col("feed").isin(*CYCLE_FEEDS), F.lit(True)))
    checked.append(without_rules.select("cycle_id", "feed", F.lit(0).alias("n")))
    return (
        reduce(DataFrame.unionByName, checked)
        .groupBy("cycle_id", "feed")
        .agg((F.max("n") == 0).alias("valid"))
    )


def complete_cycles(payloads: DataFrame) -> DataFrame:
    """Per cycle: valid feeds, and whether all five are."""
    return (
        feed_verdicts(payloads)
        .groupBy("cycle_id")
        .agg(F.count_if(F.col("valid") & F.col("feed").isin(*CYCLE_FEEDS)).alias("valid_feeds"))
        .withColumn("complete", F.col("valid_feeds") == len(CYCLE_FEEDS))
    )
