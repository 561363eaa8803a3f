"""Hand-made pings and a plain-Python replay of the headway rules."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from headwise import DEFAULTS, schema
from headwise.operators.headway import FULL_ORDER

T0 = dt.datetime(2024, 1, 1, 6, 0, 0)
NAMES = schema.PINGS.names
FINE = replace(DEFAULTS, split_rows=1)  # every stop with two pings is sorted over several tasks


def ping(minutes=0.0, vehicle="A", route="R1", stop="S1", **values):
    """One ping, `minutes` after 2024-01-01 06:00."""
    timestamp = values.pop("timestamp", T0 + dt.timedelta(minutes=minutes))
    row = {
        "timestamp": timestamp,
        "vehicle_id": vehicle,
        "route_id": route,
        "stop_id": stop,
        "stop_sequence": 0,
        "latitude": 0.0,
        "longitude": 0.0,
        "trip_id": "T1",
        "scheduled_headway_sec": 600,
        "dwell_sec": 20,
        "route_base_boardings": 1000,
        "date": None if timestamp is None else timestamp.date().isoformat(),
    }
    row.update(values)
    return tuple(row[name] for name in NAMES)


def frame(spark, rows):
    return spark.createDataFrame(rows, schema.PINGS)


def _order(row):
    key = []
    for name in FULL_ORDER:
        value = row[NAMES.index(name)]
        key.append((value is not None, value if value is not None else 0))
    return key


def replay(rows):
    """(ping..., headway_sec) for every ping, the slow way."""
    series: dict[tuple, list] = {}
    for row in rows:
        series.setdefault((row[NAMES.index("route_id")], row[NAMES.index("stop_id")]), []).append(row)
    out = []
    vehicle, stamp = NAMES.index("vehicle_id"), NAMES.index("timestamp")
    for pings in series.values():
        pings.sort(key=_order)
        for i, row in enumerate(pings):
            headway = None
            if i:
                before = pings[i - 1]
                same = row[vehicle] is not None and row[vehicle] == before[vehicle]
                if not same:
                    seconds = row[stamp].replace(microsecond=0) - before[stamp].replace(microsecond=0)
                    headway = int(seconds.total_seconds())
            out.append((*row, headway))
    return sorted(out, key=repr)
