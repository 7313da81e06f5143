"""Small landed cycles of an invented system with three stations."""

import copy
import json

STAMP = "2026-09-10T12:00:00Z"
SYSTEM = "lakeside"
CARGO, TANDEM, SCOOT = "cargo-7", "tandem-2", "scoot-9"

# id, name, place, capacity, address; vehicles by type; broken vehicles and docks, free docks
STATIONS = (
    ("q-101", "Harbour Steps", (44.25, -76.5), 31, "9 Quay Lane",
     {CARGO: 4, TANDEM: 1, SCOOT: 6}, 2, 0, 18),
    ("q-102", "Mill Bridge", (44.27, -76.48), 12, None, {TANDEM: 3}, 0, 1, 8),
    ("q-103", "Observatory", (44.31, -76.44), 16, "70 Hilltop Road", {}, 1, 2, 13),
)
TYPES = ((CARGO, "cargo_bicycle", "electric_assist"), (TANDEM, "bicycle", "human"),
         (SCOOT, "scooter_standing", "electric"))


def envelope(data):
    return {"last_updated": STAMP, "ttl": 45, "version": "3.0", "data": data}


def _described(station):
    key, name, (lat, lon), capacity, address, *_ = station
    names = [{"text": f"{name} (fr)", "language": "fr"}, {"text": name, "language": "en"}]
    out = {"station_id": key, "name": names, "lat": lat, "lon": lon, "capacity": capacity}
    return out if address is None else {**out, "address": address}


def _reported(station):
    key, *_, counts, broken, broken_docks, docks = station
    return {
        "station_id": key,
        "num_vehicles_available": sum(counts.values()),
        "vehicle_types_available": [
            {"vehicle_type_id": t, "count": n} for t, n in counts.items()
        ],
        "num_vehicles_disabled": broken,
        "num_docks_available": docks,
        "num_docks_disabled": broken_docks,
        "is_installed": True,
        "is_renting": True,
        "is_returning": True,
        "last_reported": STAMP,
    }


def cycle(stations=1):
    """Five valid feeds of the first ``stations`` stations."""
    feeds = ("system_information", "vehicle_types", "station_information", "station_status")
    held = STATIONS[:stations]
    return copy.deepcopy({
        "gbfs": envelope({
            "feeds": [{"name": f, "url": f"https://feeds.example.net/{f}.json"} for f in feeds]
        }),
        "system_information": envelope({"system_id": SYSTEM}),
        "vehicle_types": envelope({
            "vehicle_types": [
                {"vehicle_type_id": t, "form_factor": form, "propulsion_type": power}
                for t, form, power in TYPES
            ]
        }),
        "station_information": envelope({"stations": [_described(s) for s in held]}),
        "station_status": envelope({"stations": [_reported(s) for s in held]}),
    })


def bundle_lines(cycle_id, feeds):
    return [
        {"cycle_id": cycle_id, "feed": feed, "payload": p if isinstance(p, str) else json.dumps(p)}
        for feed, p in feeds.items()
    ]


def write_bundle(folder, cycle_id, feeds):
    path = folder / f"{cycle_id}.json"
    path.write_text("\n".join(json.dumps(line) for line in bundle_lines(cycle_id, feeds)) + "\n")
    return path
