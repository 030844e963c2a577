"""Small typed frames for the tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cargoledger import schemas

SHIP, INVOICED = dt.date(2026, 5, 5), dt.date(2026, 5, 28)
CREATED = dt.datetime(2026, 5, 5)


def frame(spark: SparkSession, schema: T.StructType, rows: list[dict]) -> DataFrame:
    """Rows by column name; absent columns are NULL, numbers become exact decimals."""

    def value(f: T.StructField, row: dict):
        v = row.get(f.name)
        if v is not None and isinstance(f.dataType, T.DecimalType):
            return Decimal(str(v))
        if v is not None and isinstance(f.dataType, T.DoubleType):
            return float(v)
        return v

    return spark.createDataFrame([tuple(value(f, r) for f in schema) for r in rows], schema)


def line(waybill: str, net: float, **more) -> dict:
    base = {
        "carrier": "dhl", "waybill": waybill, "service": "N", "pieces": 1, "kilos": 1,
        "ship_date": SHIP, "invoice_date": INVOICED, "net_amount": net, "currency": "MXN",
        "sender": "rem", "recipient": "dst", "is_return": False, "source_file": "t",
    }
    return base | more


def shipment(waybill: str, seller: int, name: str, model: str, sale: float | None) -> dict:
    return {
        "waybill": waybill, "seller_id": seller, "seller_name": name, "payment_model": model,
        "sale_price": sale, "created_at": CREATED,
    }


def invoices(spark, rows): return frame(spark, schemas.CARRIER_INVOICES, rows)
def shipments(spark, rows): return frame(spark, schemas.SHIPMENTS, rows)
def overweight(spark, rows=()): return frame(spark, schemas.OVERWEIGHT, list(rows))
def surcharges(spark, rows=()): return frame(spark, schemas.SURCHARGES, list(rows))
def config(spark, rows=()): return frame(spark, schemas.CREDIT_CONFIG, list(rows))
def cost_rates(spark, rows=()): return frame(spark, schemas.COST_RATES, list(rows))
def fuel_rates(spark, rows=()): return frame(spark, schemas.FUEL_RATES, list(rows))
def zone_margins(spark, rows=()): return frame(spark, schemas.ZONE_MARGINS, list(rows))
def kilo_margins(spark, rows=()): return frame(spark, schemas.KILO_MARGINS, list(rows))
def flat_rates(spark, rows=()): return frame(spark, schemas.FLAT_RATES, list(rows))
def charges(spark, rows=()): return frame(spark, schemas.CHARGES, list(rows))
def payments(spark, rows=()): return frame(spark, schemas.PAYMENTS, list(rows))
