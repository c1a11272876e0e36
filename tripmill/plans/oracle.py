"""The registered queries as SQL for a second engine."""

from __future__ import annotations

from tripmill.functions.labels import OTHER_PAYMENT, PAYMENT_LABELS, WEEKDAY_LABELS
from tripmill.plans.catalog import MAX_DIST, MONTH
from tripmill.sources.schema import TRIP_SCHEMA

TRIPS = """
trips AS (
  SELECT
    CAST(l_suppkey AS INTEGER) AS VendorID,
    CASE WHEN l_orderkey % 101 = 0 THEN NULL
         ELSE l_shipdate + CAST((l_orderkey * 7 + l_linenumber * 5) % 24 AS INTEGER)
                           * INTERVAL '1' HOUR END AS pickup_datetime,
    l_shipdate + CAST((l_orderkey * 7 + l_linenumber * 5) % 24 + 1 AS INTEGER)
                 * INTERVAL '1' HOUR AS dropoff_datetime,
    CAST(l_linenumber AS DOUBLE) + (l_orderkey % 5) * CAST(0.5 AS DOUBLE)
      - CAST(0.5 AS DOUBLE) AS passenger_count,
    (l_quantity - 1) * CAST(0.8 AS DOUBLE) AS trip_distance,
    CASE WHEN l_orderkey % 11 = 0 THEN 0
         WHEN l_orderkey % 13 = 0 THEN 6
         WHEN l_orderkey % 17 = 0 THEN NULL
         ELSE CAST(substr(o_orderpriority, 1, 1) AS BIGINT) END AS payment_type,
    CASE WHEN l_orderkey % 19 = 0 THEN CAST(0.0 AS DOUBLE)
         WHEN l_orderkey % 23 = 0 THEN -l_extendedprice / 1000
         ELSE l_extendedprice / 1000 END AS fare_amount,
    l_extendedprice / 1000 * l_discount AS tip_amount,
    l_extendedprice / 1000 * (1 + l_tax) AS total_amount,
    CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE s_nationkey END AS PULocationID,
    CASE WHEN l_partkey % 47 = 0 THEN NULL ELSE c_nationkey END AS DOLocationID,
    CASE WHEN l_linestatus = 'O' THEN 'yellow' ELSE 'green' END AS taxi_type,
    CASE WHEN l_orderkey % 7 = 0 THEN substr(CAST(o_orderdate AS VARCHAR), 1, 7)
         ELSE substr(CAST(l_shipdate AS VARCHAR), 1, 7) END AS file_month
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
)"""

ZONES = """
zones AS (
  SELECT n_nationkey AS LocationID, r_name AS Borough,
         concat('ZONE_', CAST(n_nationkey % 20 AS VARCHAR)) AS Zone
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""

FIGURES = """
    ROUND(SUM(total_amount), 2) AS total_revenue, ROUND(AVG(fare_amount), 4) AS avg_fare,
    ROUND(AVG(trip_distance), 4) AS avg_distance, ROUND(AVG(tip_amount), 4) AS avg_tip"""

COMPLETE_MONTHS = """
complete AS (
  SELECT file_month AS monat FROM trips WHERE taxi_type = 'yellow' AND file_month IS NOT NULL
  INTERSECT
  SELECT file_month FROM trips WHERE taxi_type = 'green'
)"""

HOUR = "extract(hour FROM pickup_datetime)"
WEEKDAY = "extract(dow FROM pickup_datetime)"


def _colour(dataset: str) -> str:
    return "" if dataset == "both" else f" AND taxi_type = '{dataset}'"


def _chosen(dataset: str, month: str = "") -> str:
    """The filtered trips as a named subquery."""
    in_month = f" AND strftime(pickup_datetime, '%Y-%m') = '{month}'" if month else ""
    return f"""{TRIPS},
chosen AS (
  SELECT * FROM trips
  WHERE pickup_datetime IS NOT NULL{in_month}{_colour(dataset)}
    AND trip_distance > 0 AND trip_distance <= {MAX_DIST} AND fare_amount >= 0.0
)"""


def _kpis(dataset: str, month: str = "") -> str:
    return f"WITH {_chosen(dataset, month)} SELECT COUNT(*) AS total_trips, {FIGURES} FROM chosen"


def _grouped(
    key: str, name: str, values: str, dataset: str = "both", where: str = "TRUE", month: str = ""
) -> str:
    return (
        f"WITH {_chosen(dataset, month)} SELECT {key} AS {name}, {values} "
        f"FROM chosen WHERE {where} GROUP BY 1 ORDER BY 1"
    )


def _label(code: str, labels: dict[int, str], other: str | None = None) -> str:
    cases = " ".join(f"WHEN {key} THEN '{label}'" for key, label in labels.items())
    rest = f" ELSE '{other}'" if other else ""
    return f"CASE {code} {cases}{rest} END"


def _payments() -> str:
    return f"""WITH {_chosen("both")}, counted AS (
  SELECT payment_type, COUNT(*) AS anzahl FROM chosen
  WHERE payment_type IS NOT NULL AND payment_type BETWEEN 1 AND 6 GROUP BY payment_type
)
SELECT payment_type, anzahl,
  {_label("payment_type", PAYMENT_LABELS, OTHER_PAYMENT)} AS Zahlungsart,
  ROUND(anzahl / CAST((SELECT SUM(anzahl) FROM counted) AS DOUBLE), 6) AS anteil
FROM counted ORDER BY anzahl DESC, payment_type"""


def _zones(location: str, dataset: str) -> str:
    return f"""WITH {_chosen(dataset)}, {ZONES}
SELECT Zone, Borough, COUNT(*) AS fahrten
FROM chosen JOIN zones ON {location} = LocationID
WHERE {location} IS NOT NULL
GROUP BY Zone, Borough ORDER BY fahrten DESC, Zone, Borough LIMIT 15"""


def _weekdays() -> str:
    return f"""WITH {_chosen("both")}, grouped AS (
  SELECT {WEEKDAY} AS dow_num, COUNT(*) AS fahrten, ROUND(AVG(fare_amount), 4) AS avg_fare
  FROM chosen GROUP BY 1
)
SELECT dow_num, fahrten, avg_fare,
  {_label("dow_num", WEEKDAY_LABELS)} AS Wochentag
FROM grouped ORDER BY (dow_num + 6) % 7"""


def _trend(dataset: str) -> str:
    return f"""WITH {TRIPS}, {COMPLETE_MONTHS}, figures AS (
  SELECT file_month, COUNT(*) AS n, {FIGURES}
  FROM trips
  WHERE pickup_datetime IS NOT NULL AND strftime(pickup_datetime, '%Y-%m') = file_month
    AND trip_distance > 0 AND fare_amount >= 0{_colour(dataset)}
  GROUP BY file_month
)
SELECT monat, COALESCE(n, 0) AS total_trips, total_revenue, avg_fare, avg_distance, avg_tip
FROM complete LEFT JOIN figures ON monat = file_month ORDER BY monat"""


def _source_counts() -> str:
    return f"""WITH {TRIPS}, files AS (
  SELECT DISTINCT file_month, unnest(['yellow', 'green']) AS colour FROM trips
  WHERE file_month IS NOT NULL
)
SELECT colour AS taxi_type, files.file_month AS monat, COUNT(trips.taxi_type) AS total
FROM files LEFT JOIN trips ON trips.file_month = files.file_month AND trips.taxi_type = colour
GROUP BY 1, 2 ORDER BY 1, 2"""


def _preview_both() -> str:
    columns = TRIP_SCHEMA.names
    order = ", ".join(f"{name} NULLS LAST" for name in columns)
    return f"WITH {TRIPS} SELECT {', '.join(columns)} FROM trips ORDER BY {order} LIMIT 30"


def _preview_yellow() -> str:
    columns = [name for name in TRIP_SCHEMA.names if name != "taxi_type"]
    order = ", ".join(f"{name} NULLS LAST" for name in columns)
    shown = ", ".join(
        f"{name} AS tpep_{name}" if name.endswith("_datetime") else name for name in columns
    )
    return (
        f"WITH {TRIPS} SELECT {shown} FROM trips "
        f"WHERE taxi_type = 'yellow' ORDER BY {order} LIMIT 30"
    )


def _profile() -> str:
    values = ["COUNT(*) AS trips"]
    for field in TRIP_SCHEMA:
        name = field.name
        if name == "taxi_type":
            continue
        values.append(f"COUNT({name}) AS n_{name}")
        if name.endswith("_datetime"):
            values += [f"MIN({name}) AS min_{name}", f"MAX({name}) AS max_{name}"]
        elif field.dataType.typeName() == "double":
            values.append(f"ROUND(SUM({name}), 2) AS sum_{name}")
        else:
            values.append(f"CAST(SUM({name}) AS BIGINT) AS sum_{name}")
    return f"WITH {TRIPS} SELECT taxi_type, {', '.join(values)} FROM trips GROUP BY taxi_type"


# Per panel of a refresh: the query it shows and its entry, count and values.
PANELS = {
    "kpis": ("kpis_both", "''", "total_trips"),
    "daily_trips": ("daily_trips_both", "CAST(tag AS VARCHAR)", "fahrten"),
    "hourly_trips": ("hourly_trips_both", "CAST(stunde AS VARCHAR)", "fahrten"),
    "payment_dist": ("payment_dist_both", "concat(payment_type, ' ', Zahlungsart)", "anzahl"),
    "distance_dist": ("distance_dist_both", "CAST(km_bin AS VARCHAR)", "anzahl"),
    "top_pickup_zones": ("top_pickup_zones_both", "concat(Zone, ' ', Borough)", "fahrten"),
    "top_dropoff_zones": ("top_dropoff_zones_both", "concat(Zone, ' ', Borough)", "fahrten"),
    "hourly_fare_tip": ("hourly_fare_tip_both", "CAST(stunde AS VARCHAR)", "NULL"),
    "passenger_dist": ("passenger_dist_both", "CAST(passagiere AS VARCHAR)", "fahrten"),
    "weekday_stats": ("weekday_stats_both", "concat(dow_num, ' ', Wochentag)", "fahrten"),
    "monthly_kpis": ("monthly_kpis_both", "monat", "total_trips"),
}
PANEL_VALUES = {
    "kpis": {"total_revenue", "avg_fare", "avg_distance", "avg_tip"},
    "payment_dist": {"anteil"},
    "hourly_fare_tip": {"avg_fare", "avg_tip"},
    "weekday_stats": {"avg_fare"},
    "monthly_kpis": {"total_revenue", "avg_fare", "avg_distance", "avg_tip"},
}


def _dashboard(sql: dict[str, str]) -> str:
    values = ["total_revenue", "avg_fare", "avg_distance", "avg_tip", "anteil"]
    return " UNION ALL ".join(
        f"SELECT '{panel}' AS panel, {entry} AS eintrag, CAST({count} AS BIGINT) AS fahrten, "
        + ", ".join(
            f"CAST({value if value in PANEL_VALUES.get(panel, ()) else 'NULL'} AS DOUBLE)"
            f" AS {value}"
            for value in values
        )
        + f" FROM ({sql[query]})"
        for panel, (query, entry, count) in PANELS.items()
    )


def oracle_sql() -> dict[str, str]:
    trips_and = "COUNT(*) AS fahrten"
    sql = {
        "kpis_yellow": _kpis("yellow"),
        "kpis_green": _kpis("green"),
        "kpis_both": _kpis("both"),
        "kpis_both_month": _kpis("both", MONTH),
        "daily_trips_both": _grouped("CAST(pickup_datetime AS DATE)", "tag", trips_and),
        "daily_trips_both_month": _grouped(
            "CAST(pickup_datetime AS DATE)", "tag", trips_and, month=MONTH
        ),
        "hourly_trips_yellow": _grouped(HOUR, "stunde", trips_and, "yellow"),
        "hourly_trips_green": _grouped(HOUR, "stunde", trips_and, "green"),
        "hourly_trips_both": _grouped(HOUR, "stunde", trips_and),
        "payment_dist_both": _payments(),
        "distance_dist_both": _grouped(
            "CAST(floor(trip_distance) AS INTEGER)",
            "km_bin",
            "COUNT(*) AS anzahl",
            where="trip_distance < 30",
        ),
        "top_pickup_zones_yellow": _zones("PULocationID", "yellow"),
        "top_pickup_zones_both": _zones("PULocationID", "both"),
        "top_dropoff_zones_green": _zones("DOLocationID", "green"),
        "top_dropoff_zones_both": _zones("DOLocationID", "both"),
        "hourly_fare_tip_both": _grouped(
            HOUR,
            "stunde",
            "ROUND(AVG(fare_amount), 4) AS avg_fare, ROUND(AVG(tip_amount), 4) AS avg_tip",
            where="fare_amount > 0",
        ),
        "passenger_dist_both": _grouped(
            "CAST(passenger_count AS INTEGER)",
            "passagiere",
            trips_and,
            where="passenger_count BETWEEN 1 AND 8",
        ),
        "weekday_stats_both": _weekdays(),
        "monthly_kpis_yellow": _trend("yellow"),
        "monthly_kpis_green": _trend("green"),
        "monthly_kpis_both": _trend("both"),
        "available_months": (
            f"WITH {TRIPS}, {COMPLETE_MONTHS} SELECT monat FROM complete ORDER BY 1"
        ),
        "source_counts": _source_counts(),
        "raw_preview_yellow": _preview_yellow(),
        "raw_preview_both": _preview_both(),
        "combined_trips_profile": _profile(),
    }
    sql["dashboard_both"] = _dashboard(sql)
    return sql
