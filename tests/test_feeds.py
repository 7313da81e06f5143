import json

import pytest
from pyspark.sql import functions as F

from feed_fixtures import TANDEM, bundle_lines, cycle
from stationflow.plans import ingest as I
from stationflow.sources import feeds as G

CYCLE = "20260910T120000Z"


def landed(spark, *cycles):
    rows = [
        (line["cycle_id"], line["feed"], line["payload"])
        for cycle_id, feeds in cycles
        for line in bundle_lines(cycle_id, feeds)
    ]
    return G.from_bundles(spark.createDataFrame(rows, "cycle_id string, feed string, payload string"))


def changed(**edits):
    """A cycle with ``feed__path`` edits applied; ``None`` deletes."""
    feeds = cycle()
    for target, value in edits.items():
        feed, _, path = target.partition("__")
        spot, keys = feeds[feed], [int(k) if k.isdigit() else k for k in path.split("__")]
        for key in keys[:-1]:
            spot = spot[key]
        if value is None:
            del spot[keys[-1]]
        else:
            spot[keys[-1]] = value
    return feeds


STATUS = "station_status__data__stations__0__"
INFO = "station_information__data__stations__0__"

BROKEN = {
    "negative": ({STATUS + "num_vehicles_available": -1}, "count"),
    "fraction": ({STATUS + "num_vehicles_available": 1.5}, "count"),
    "no_count": ({STATUS + "num_vehicles_available": None}, "required"),
    "bad_entry": ({STATUS + "vehicle_types_available": [{"vehicle_type_id": TANDEM}]}, "counts"),
    "bad_flag": ({STATUS + "is_renting": "maybe"}, "flag"),
    "bad_time": ({STATUS + "last_reported": "yesterday"}, "time"),
    "plain_name": ({INFO + "name": "Main St"}, "localized"),
    "empty_names": ({INFO + "name": []}, "no_localized_name"),
    "latitude": ({INFO + "lat": 91}, "range"),
    "longitude": ({INFO + "lon": "-180.5"}, "range"),
    "capacity": ({INFO + "capacity": -2}, "count"),
    "rental": ({INFO + "rental_methods": ["key", "cash"]}, "enum"),
    "parking": ({INFO + "parking_type": "roof"}, "enum"),
    "area": ({INFO + "station_area": {"type": "Point", "coordinates": []}}, "area"),
    "uris": ({INFO + "rental_uris": "none"}, "uris"),
    "docks": ({INFO + "vehicle_docks_capacity": [{"vehicle_type_ids": ["a"], "count": -1}]}, "counts"),
    "version": ({"station_status__version": "2.3"}, "enum"),
    "ttl": ({"vehicle_types__ttl": -5}, "count"),
    "form": ({"vehicle_types__data__vehicle_types__0__form_factor": "boat"}, "enum"),
    "system": ({"system_information__data__system_id": None}, "required"),
    "feed_name": ({"gbfs__data__feeds__0__name": "weather"}, "enum"),
    "feed_url": ({"gbfs__data__feeds__0__url": "not a url"}, "url"),
    "no_list": ({"station_status__data": {}}, "required"),
    "empty": ({"station_status__data": {"stations": []}}, "no_rows"),
    "number_id": ({STATUS + "station_id": 7}, "text"),
    "object_id": ({INFO + "station_id": {"a": 1}}, "text"),
    "number_system": ({"system_information__data__system_id": 12}, "text"),
    "number_type": ({"vehicle_types__data__vehicle_types__0__vehicle_type_id": 3}, "text"),
    "number_address": ({INFO + "address": 5}, "text"),
    "flag_phone": ({INFO + "contact_phone": True}, "text"),
    "uri_member": ({INFO + "rental_uris": {"web": 5}}, "uris"),
    "unknown_station": ({STATUS + "station_id": "ghost"}, "unknown_station"),
    "unknown_type": (
        {STATUS + "vehicle_types_available": [{"vehicle_type_id": "rickshaw-1", "count": 1}]},
        "unknown_vehicle_type",
    ),
}


def test_each_rule_rejects_its_cycle_only(spark):
    cases = {f"20260910T12{i:02d}00Z": name for i, name in enumerate(BROKEN)}
    cycles = [(c, changed(**BROKEN[name][0])) for c, name in cases.items()]
    missing, listed, twisted = cycle(), cycle(), cycle()
    del missing["vehicle_types"]
    del listed["gbfs"]["data"]["feeds"][3]
    twisted["station_status"] = "[1, 2]"
    cycles += [(CYCLE.replace("T12", "T13"), cycle()), ("20260910T140000Z", missing),
               ("20260910T150000Z", listed), ("20260910T160000Z", twisted)]
    result = I.flatten_cycles(landed(spark, *cycles))
    found = {}
    for row in result.violations.collect():
        found.setdefault(row.cycle_id, set()).add(row.rule)
    for cycle_id, name in cases.items():
        assert BROKEN[name][1] in found.get(cycle_id, set()), name
    assert found["20260910T140000Z"] == {"missing_feed"}
    assert found["20260910T150000Z"] == {"unlisted_feed"}
    assert found["20260910T160000Z"] == {"object"}
    assert "20260910T130000Z" not in found
    status, stations = result.status.collect(), result.stations.collect()
    assert len(status) == len(stations) == 1 and status[0].num_vehicles_available == 11
    assert (status[0].num_vehicles_electric, status[0].num_vehicles_human) == (10, 1)
    assert (status[0].num_vehicles_disabled, status[0].num_docks_disabled) == (2, 0)
    assert stations[0].station_name == "Harbour Steps" and stations[0].capacity == 31
    with pytest.raises(I.FeedError, match="num_vehicles_available"):
        I.require_clean(result.violations.where("rule = 'count'"))


def test_lenient_values_are_accepted(spark):
    feeds = changed(**{
        STATUS + "num_vehicles_available": "11", STATUS + "is_renting": 1,
        STATUS + "last_reported": 1788000000, INFO + "lat": "43.5",
        STATUS + "num_docks_available": 18.0, STATUS + "surprise": {"a": [1]},
        INFO + "cross_street": "", INFO + "rental_uris": {"web": "https://x.example.net", "ios": "y"},
        INFO + "post_code": "K7L",
    })
    result = I.flatten_cycles(landed(spark, (CYCLE, feeds)))
    assert result.violations.count() == 0
    row = result.status.first()
    assert row.num_vehicles_available == 11 and row.is_renting and row.num_docks_available == 18
    I.require_clean(result.violations)


def test_null_split_is_not_zero(spark):
    absent = changed(**{STATUS + "vehicle_types_available": None})
    empty = changed(**{STATUS + "vehicle_types_available": []})
    out = I.flatten_cycles(landed(spark, (CYCLE, absent), ("20260910T120500Z", empty))).status
    got = [(r.num_vehicles_electric, r.num_vehicles_human) for r in out.orderBy("observed_at").collect()]
    assert got == [(None, None), (0, 0)]


def test_object_check(spark):
    texts = ['{"a": 1}', " \n{}", "[1]", '{"a": 1},', "{}],[{}", "{}} x", '{"a": 1} {"b": 2}',
             '{"a":1},"b":{}', '"x"', "", "{", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string")
    good = [r.i for r in rows.where(G.is_json_object()).collect()]
    assert sorted(good) == [0, 1]


def test_landed_files(spark, tmp_path):
    for name, body in cycle(stations=3).items():
        path = tmp_path / CYCLE / f"{name}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps(body, indent=1))
    rows = G.read_landed(spark, str(tmp_path))
    assert {(r.cycle_id, r.feed) for r in rows.collect()} == {(CYCLE, f) for f in cycle()}
    assert G.complete_cycles(rows).first().complete
    urls = {r.feed: r.url for r in G.resolve_feed_urls(rows).collect()}
    assert urls["station_status"] == "https://feeds.example.net/station_status.json"
    summary = I.ingestion_summary(rows).first()
    assert (summary.station_count, summary.status_count) == (3, 3)
    assert summary.matched_station_status_count == summary.processed_station_status_count == 3


def test_three_stations_of_one_cycle(spark):
    rows = I.flatten_cycles(landed(spark, (CYCLE, cycle(stations=3)))).status.collect()
    split = {r.station_id: (r.num_vehicles_electric, r.num_vehicles_human) for r in rows}
    assert split == {"q-101": (10, 1), "q-102": (0, 3), "q-103": (0, 0)}


def test_preview_repeats_stations_but_not_types(spark):
    feeds = cycle(stations=2)
    for record in feeds["station_status"]["data"]["stations"]:
        record["station_id"] = "ghost"
    types = cycle(stations=2)
    for record in types["station_status"]["data"]["stations"]:
        record["vehicle_types_available"] = [{"vehicle_type_id": "sled", "count": 1}]
    found = I.cycle_violations(landed(spark, (CYCLE, feeds), ("20260910T120500Z", types)))
    shown = {r.rule: r.preview for r in I.violation_preview(found).collect()}
    assert list(shown["unknown_station"]) == ["ghost", "ghost"]
    assert list(shown["unknown_vehicle_type"]) == ["sled"]


def test_rules_table(spark):
    rules = G.rules_table(spark)
    assert rules.where("feed = 'station_information' and path = 'lat' and rule = 'range'").count() == 1


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("feed", G.CYCLE_FEEDS)
def test_findings_parse_each_payload_once(spark, feed):
    """A filter on the findings once went below the explode, with the parsing in it."""
    rows = spark.createDataFrame([], "cycle_id string, observed_at timestamp, feed string, payload string")
    bodies = 1 if G.FEEDS[feed].suspects is None else 2  # plain texts, and variants
    plan = plan_of(G.feed_violations(rows, feed).select("cycle_id", "rule"))
    assert plan.count("StructField(last_updated") <= bodies


def test_verdicts_read_each_payload_once(spark):
    rows = spark.range(1).selectExpr(
        "'c' AS cycle_id", "current_timestamp() AS observed_at", "uuid() AS feed", "uuid() AS payload"
    )
    assert " Join " not in plan_of(G.feed_verdicts(rows))


def test_a_feed_without_rules_is_valid(spark):
    rows = spark.createDataFrame(
        [("c", None, "alerts", "[]"), ("c", None, G.SYSTEM_INFORMATION, "[]")],
        "cycle_id string, observed_at timestamp, feed string, payload string",
    )
    found = {(r.cycle_id, r.feed): r.valid for r in G.feed_verdicts(rows).collect()}
    assert found == {("c", "alerts"): True, ("c", G.SYSTEM_INFORMATION): False}


def test_whole_numbers_in_every_spelling(spark):
    texts = ["7", "-7", "007", "+7", " 7 ", "7.0", "7.5", "7e0", "-0", "x", "", None,
             "9223372036854775807", "9223372036854775808", "9223372036854775807.0"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    found = [r[0] for r in rows.orderBy("i").selectExpr(G.whole("x")).collect()]
    top = 9223372036854775807
    assert found == [7, -7, 7, 7, 7, 7, None, 7, 0, None, None, None, top, None, top]


def test_suspects_are_those_of_the_three_plain_patterns(spark):
    texts = [
        '{"station_id":1}', '{"station_id" : "a"}', '{"station_id":null}', "{'station_id': [1]}",
        '{"station\\u005fid":"a"}', '{"name":"\\u00e9"}', '{"a":"\\u00e9", "b":1}', '{"_odd":[]}',
        '{"x":"\\\\station_id\\":1"}', '\\"station_id":1', '{"address":2}', '{}', '',
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    for feed in G.FEEDS.values():
        if feed.texts:
            names = "|".join(feed.texts)
            plain = rf"""["'](?:{names})["']\s*:\s*[^"'\sn]|\\u[^"']*["']\s*:|["']{G.ODD}["']"""
            differ = F.col("x").rlike(plain) != F.col("x").rlike(feed.suspects)
            assert rows.where(differ).count() == 0


def test_suspects_are_found_by_their_names_first(spark):
    texts = [
        '{"station_id":1}', '{"station_id" : "a"}', '{"station_id":null}', "{'station_id': [1]}",
        '{"station\\u005fid":"a"}', '{"a":"\\u00e9", "b":1}', '{"_odd":[]}', '{"x_station_id":1}',
        '{"system_id"\n:\t{}}', '{"vehicle_type_id":"a","vehicle_type_id":true}', '{}', '',
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    for feed in G.FEEDS.values():
        if feed.texts:
            differ = F.col("x").rlike(feed.suspects) != feed.suspect(F.col("x"))
            assert rows.where(differ).count() == 0


def test_absent_fields_are_not_listed_as_broken(spark):
    """A rule of two alternatives was true of records without its field, and all were listed."""
    rows = landed(spark, (CYCLE, cycle()))
    for feed in G.CYCLE_FEEDS:
        broken = F.expr(G._any_broken(G.FEEDS[feed].rules, "item"))
        assert not G.items(G.parse(rows, feed), feed).where(broken).count(), feed


def test_object_check_with_its_own_key(spark):
    key = f'"{G.END_KEY}"'
    texts = [f"{{{key}:0}}", f"{{}},{key}:0}}", f"{{}},{key}:0", f"{{}},{key}:0}} x", f"{{}}]{key}",
             '{},"\\u005fend_of_payload":0}', f'{{"a":"{G.END_KEY}"}}', '{"a":"\\u00e9"}', '{},']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string")
    good = [r.i for r in rows.where(G.is_json_object()).collect()]
    assert sorted(good) == [0, 6, 7]
