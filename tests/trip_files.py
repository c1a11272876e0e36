"""Hand-made trips and the monthly files they are written to."""

import datetime
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

PREFIX = {"yellow": "tpep", "green": "lpep"}
TYPES = {
    "VendorID": pa.int32(),
    "pickup_datetime": pa.timestamp("us"),
    "dropoff_datetime": pa.timestamp("us"),
    "passenger_count": pa.float64(),
    "trip_distance": pa.float64(),
    "payment_type": pa.int64(),
    "fare_amount": pa.float64(),
    "tip_amount": pa.float64(),
    "total_amount": pa.float64(),
    "PULocationID": pa.int32(),
    "DOLocationID": pa.int32(),
}


def at(text):
    return datetime.datetime.fromisoformat(text)


def trip(pickup="2025-11-05 10:30:00", /, **values):
    """An ordinary trip with some of its values replaced."""
    usual = {
        "VendorID": 1,
        "pickup_datetime": at(pickup) if pickup else None,
        "dropoff_datetime": at("2025-11-05 11:00:00"),
        "passenger_count": 1.0,
        "trip_distance": 2.5,
        "payment_type": 1,
        "fare_amount": 10.0,
        "tip_amount": 2.0,
        "total_amount": 13.0,
        "PULocationID": 1,
        "DOLocationID": 2,
    }
    assert values.keys() <= usual.keys()
    return {**usual, **values}


def arrow_table(colour, trips, **types):
    types = {**TYPES, **types}
    columns = {
        f"{PREFIX[colour]}_{name}" if name.endswith("_datetime") else name: pa.array(
            [row[name] for row in trips], type=kind
        )
        for name, kind in types.items()
    }
    return pa.table(columns)


def write(folder, colour, month, trips, **types):
    path = Path(folder) / f"{colour}_tripdata_{month}.parquet"
    pq.write_table(arrow_table(colour, trips, **types), path)
    return path


ZONES = """LocationID,Borough,Zone,service_zone
1,Queens,Airport,Airports
2,Manhattan,"Penn Station, Madison Sq West",Yellow Zone
3,Manhattan,Twin,Yellow Zone
4,Manhattan,Twin,Yellow Zone
5,Bronx,Never Used,Boro Zone
264,Unknown,N/A,N/A
"""


def write_zones(folder, text=ZONES):
    path = Path(folder) / "zones.csv"
    path.write_text(text)
    return str(path)
