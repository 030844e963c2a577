"""Table schemas and the conversions that make a frame obey one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoledger.functions.money import AMOUNT, CENTS, FINE, RATE

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DateType(), T.BooleanType()
KILO, TS = T.DoubleType(), T.TimestampNTZType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


CARRIER_INVOICES = _table(
    carrier=S, waybill=S, account=S, reference=S, service=S, origin=S, destination=S,
    pieces=I, kilos=KILO, ship_date=D, invoice_date=D, invoice_no=S,
    freight=AMOUNT, insurance=AMOUNT, discount=AMOUNT, surcharges=AMOUNT, tax=AMOUNT,
    net_amount=AMOUNT, currency=S, sender=S, recipient=S, is_return=B, source_file=S, zone=S,
)
CLIENT_INVOICES = _table(waybill=S, client=S, total=AMOUNT, source_file=S)
SHIPMENTS = _table(
    waybill=S, seller_id=L, seller_name=S, payment_model=S, sale_price=AMOUNT, created_at=TS
)
OVERWEIGHT = _table(waybill=S, amount=AMOUNT)
RECHARGES = _table(seller_id=L, seller_name=S, recharges=AMOUNT)
CREDIT_CONFIG = _table(
    seller_id=L, client=S, method=S, value=AMOUNT, note=S, margin=RATE, credit_days=I
)
FLAT_RATES = _table(
    seller_id=L, client=S, carrier=S, zone=S, kilo_min=KILO, kilo_max=KILO, price=AMOUNT,
    valid_from=D, valid_to=D,
)
COST_RATES = _table(
    carrier=S, zone=S, kilo_min=KILO, kilo_max=KILO, cost=AMOUNT, valid_from=D, valid_to=D, service=S
)
FUEL_RATES = _table(carrier=S, valid_from=D, valid_to=D, pct=RATE, service=S)
ZONE_MARGINS = _table(seller_id=L, zone=S, margin=RATE)
KILO_MARGINS = _table(seller_id=L, kilo_min=KILO, kilo_max=KILO, margin=RATE)
SURCHARGE_MAP = _table(carrier=S, concept=S, source_column=S)
SURCHARGES = _table(carrier=S, waybill=S, concept=S, amount=AMOUNT)
CLIENT_CARRIERS = _table(seller_id=L, carrier=S)
PERIODS = _table(month=S, status=S, cost=CENTS, income=CENTS, profit=CENTS, closed_at=TS)
RECONCILIATION = _table(
    waybill=S, carrier=S, client=S, seller_id=L, payment_model=S, account_type=S, method=S,
    is_return=B, has_cost=B, cost=CENTS, sale_price=AMOUNT, overweight_billed=CENTS,
    tariff_price=FINE, extra=CENTS, surcharges=CENTS, income=CENTS, margin=CENTS, status=S,
    ship_month=S, invoice_month=S,
)
CHARGES = _table(
    seller_id=L, client=S, month=S, waybills=L, amount=CENTS, status=S, generated_at=TS, note=S,
    account_type=S, concept=S, paid_amount=CENTS, sent_date=D, due_date=D,
)
PAYMENTS = _table(
    payment_id=L, seller_id=L, month=S, paid_on=D, amount=AMOUNT, note=S, recorded_at=TS
)
CHARGE_ATTACHMENTS = _table(seller_id=L, month=S, filename=S, path=S, uploaded_at=TS)
LOAD_LOG = _table(table_name=S, carrier=S, since=S, row_count=L, loaded_at=TS)
TARIFF_VERSIONS = _table(
    seller_id=L, client=S, carrier=S, version=I, method=S, margin=RATE, vat=RATE,
    valid_from=D, valid_to=D, path=S, filename=S, bytes=L, created_at=TS,
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to ``schema`` column by column, in its order; a missing column is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def check_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Fail unless names, order and types are exactly those of ``schema``."""
    found = [(f.name, f.dataType) for f in df.schema]
    wanted = [(f.name, f.dataType) for f in schema]
    if found != wanted:
        raise ValueError(f"schema differs: {found} instead of {wanted}")
    return df


def evolve_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Additive migration: columns of ``schema`` that ``df`` lacks become typed NULLs."""

    def column(f: T.StructField) -> Column:
        source = F.col(f.name) if f.name in df.columns else F.lit(None)
        return source.cast(f.dataType).alias(f.name)

    extra = [F.col(c) for c in df.columns if c not in schema.names]
    return df.select([column(f) for f in schema] + extra)
