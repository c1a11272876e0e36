"""Buckets and the labels of coded columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Payment codes, weekday numbers and the label of an unmapped code.
PAYMENT_LABELS = {
    1: "Kreditkarte",
    2: "Bar",
    3: "Keine Gebühr",
    4: "Streit",
    5: "Unbekannt",
    6: "Storniert",
}
OTHER_PAYMENT = "Sonstige"
WEEKDAY_LABELS = {0: "So", 1: "Mo", 2: "Di", 3: "Mi", 4: "Do", 5: "Fr", 6: "Sa"}


def _lookup(labels: dict[int, str], code: Column) -> Column:
    entries = [
        part
        for key, label in labels.items()
        for part in (F.lit(key).cast("bigint"), F.lit(label))
    ]
    whole = code.cast("bigint")
    return F.when(whole == code, F.create_map(*entries)[whole])


def payment_label(code: Column) -> Column:
    return F.coalesce(_lookup(PAYMENT_LABELS, code), F.lit(OTHER_PAYMENT))


def weekday_label(dow: Column) -> Column:
    return _lookup(WEEKDAY_LABELS, dow)


def mile_bin(miles: Column) -> Column:
    return F.floor(miles).cast("int")


def head_count(passengers: Column) -> Column:
    """Whole passengers, halves rounded to the even neighbour (0.5 -> 0,
    1.5 -> 2, 2.5 -> 2); a plain cast would truncate."""
    return F.rint(passengers).cast("int")
