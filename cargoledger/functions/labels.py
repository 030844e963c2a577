"""Display helpers of the tariff sheets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names of (carrier, service code).
SERVICE_NAMES = (
    ("dhl", "G", "ECONOMY SELECT DOMESTIC"),
    ("dhl", "N", "EXPRESS DOMESTIC"),
    ("fedex", "Express Saver", "EXPRESS SAVER"),
    ("paquete_express", "Standard", "STANDARD"),
)
GENERAL_SERVICE = "GENERAL"


def service_name(carrier: Column, service: Column) -> Column:
    """Display name of a carrier's service, else its code, else the general name."""
    name = F.lit(None).cast("string")
    for known_carrier, code, display in reversed(SERVICE_NAMES):
        name = F.when((carrier == known_carrier) & (service == code), display).otherwise(name)
    return F.coalesce(name, F.nullif(service, F.lit("")), F.lit(GENERAL_SERVICE))


def zone_order(zone: Column) -> list[Column]:
    """Sort keys: numeric zones first by value, then the others by text."""
    numeric = F.coalesce(zone.rlike("^[0-9]+$"), F.lit(False))
    return [
        (~numeric).asc(),
        F.when(numeric, zone.try_cast("decimal(38,0)")).asc_nulls_last(),
        zone.asc_nulls_last(),
    ]


def _plain(c: Column) -> Column:
    """Number text with at least one decimal: 5 -> 5.0."""
    return F.regexp_replace(c.cast("decimal(28,4)").cast("string"), r"(\.[0-9]+?)0+$", "$1")


def band_label(kilo_min: Column, kilo_max: Column) -> Column:
    """Label of a kilo band: one-kilo bands by their start, open ends spelled out."""
    one_kilo = (kilo_max - kilo_min == 1) & (kilo_min == F.floor(kilo_min))
    upper = F.coalesce(_plain(kilo_max), F.lit("∞"))
    lower = F.coalesce(_plain(kilo_min), F.lit("0"))
    return (
        F.when(kilo_min.isNull() & kilo_max.isNull(), F.lit("—"))
        .when(one_kilo, F.concat(kilo_min.cast("bigint").cast("string"), F.lit(" kg")))
        .otherwise(F.concat(lower, F.lit(" a "), upper))
    )
