"""Reconciliation of carrier cost against client billing, one row per waybill.

dedup_invoices -> attribute -> classify_account -> value -> label.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoledger.functions.cleaners import month_of, return_origin
from cargoledger.functions.money import AMOUNT, FINE, cents, exact, fine, or_zero, plus
from cargoledger.operators.pricing import AUTOMATIC, PriceBook, normalise_method, price
from cargoledger.rules import DEFAULT_RULES, Rules
from cargoledger.schemas import RECONCILIATION, conform
from cargoledger.sources.tables import free_shuffles, remove, stored

# Columns of an invoice line the reconciliation reads; the first of tied lines is fixed by them.
LINE_COLUMNS = (
    "carrier", "reference", "service", "kilos", "zone", "ship_date", "sender", "is_return",
)


def dedup_invoices(invoices: DataFrame, *more: str) -> DataFrame:
    """First line of each waybill by invoice date, across carriers; undated lines come last.

    Ties go to the lowest net amount, then to the remaining columns in a fixed order; columns in
    ``more`` are carried along and only extend that order. Each task keeps its best line per
    waybill before the shuffle, so a waybill with very many lines does not load one task.
    """
    columns = ["waybill", "invoice_date", "net_amount", *LINE_COLUMNS]
    columns += [c for c in more if c not in columns]
    order = [F.col(c).asc_nulls_last() for c in columns[1:]]
    window = Window.partitionBy("waybill").orderBy(*order)
    return (
        invoices.select(columns)
        .withColumn("_line", F.row_number().over(window))
        .filter(F.col("_line") == 1)
        .drop("_line")
    )


def dedup_parts(parts: Iterable[DataFrame], path: str, *more: str) -> DataFrame:
    """`dedup_invoices` of all parts together, one part after the other, written under ``path``.

    The first lines of the parts so far meet the lines of the next. The shuffle of a part, and the lines that it has
    replaced, are let go before the next one, so that disk holds those of one part at a time.
    """
    held = None
    for k, part in enumerate(parts):
        first = dedup_invoices(part, *more) if held is None else dedup_invoices(
            held.unionByName(part.select(held.columns)), *more
        )
        held = stored(first, f"{path}/{k}")
        free_shuffles(held.sparkSession)
        if k:
            remove(held.sparkSession, f"{path}/{k - 1}")
    return held


def overweight_by_waybill(overweight: DataFrame) -> DataFrame:
    return overweight.groupBy("waybill").agg(
        F.sum("amount").cast(AMOUNT).alias("overweight")
    )


def surcharge_by_waybill(surcharges: DataFrame) -> DataFrame:
    """Surcharge cost per waybill, whichever carrier and concept."""
    return surcharges.groupBy("waybill").agg(
        F.sum("amount").cast(AMOUNT).alias("surcharge_cost")
    )


def charges_by_waybill(overweight: DataFrame, surcharges: DataFrame) -> DataFrame:
    """Both sums per waybill in one aggregation, hence one shuffle."""
    nothing = F.lit(None).cast(AMOUNT)
    both = overweight.select(
        "waybill", F.col("amount").alias("overweight"), nothing.alias("surcharge_cost")
    ).unionByName(
        surcharges.select(
            "waybill", nothing.alias("overweight"), F.col("amount").alias("surcharge_cost")
        )
    )
    return both.groupBy("waybill").agg(
        F.sum("overweight").cast(AMOUNT).alias("overweight"),
        F.sum("surcharge_cost").cast(AMOUNT).alias("surcharge_cost"),
    )


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[f"{prefix}{c}" for c in df.columns])


def original_shipments(invoices: DataFrame, shipments: DataFrame) -> DataFrame:
    """For each return waybill and original it names: who shipped the original.

    Read from the few return lines alone. Joining all lines on their mostly NULL origin would
    send most of them to one task.
    """
    named = (
        invoices.filter(F.col("is_return"))
        .select(
            F.col("waybill").alias("return_waybill"),
            return_origin(F.col("is_return"), F.col("reference")).alias("origin"),
        )
        .filter(F.col("origin").isNotNull())
        .distinct()
    )
    original = _prefixed(
        shipments.select("waybill", "seller_id", "seller_name", "payment_model"), "original_"
    )
    return named.join(original, F.col("origin") == F.col("original_waybill")).drop("origin")


def attribute(
    invoices: DataFrame,
    shipments: DataFrame,
    overweight: DataFrame,
    surcharges: DataFrame,
    rules: Rules = DEFAULT_RULES,
) -> DataFrame:
    """Cost and billing side by side: one row per waybill known to either.

    Every input is placed by waybill once. The charges join each side before the full outer
    join, since its coalesced key would need a new placement.
    """
    lines = dedup_invoices(invoices)
    lines = lines.withColumn("origin", return_origin(F.col("is_return"), F.col("reference")))
    charges = charges_by_waybill(overweight, surcharges)
    found = original_shipments(invoices, shipments)
    # The origin test is a range so that waybill stays the only join key: with two keys the
    # lines would have to be placed anew.
    same_return = (F.col("waybill") == F.col("return_waybill")) & F.col("origin").between(
        F.col("original_waybill"), F.col("original_waybill")
    )
    cost_side = _prefixed(
        lines.join(charges, "waybill", "left").join(found, same_return, "left"), "c_"
    )
    billing_side = _prefixed(shipments.join(charges, "waybill", "left"), "s_")
    both = cost_side.join(billing_side, F.col("c_waybill") == F.col("s_waybill"), "full_outer")

    is_return = F.coalesce("c_is_return", F.lit(False))
    resolved = is_return & F.col("c_original_waybill").isNotNull()

    def owner(column: str) -> Column:
        return F.coalesce(f"s_{column}", F.when(is_return, F.col(f"c_original_{column}")))

    def charge(column: str) -> Column:
        return or_zero(F.coalesce(f"c_{column}", f"s_{column}")).cast(AMOUNT)

    return both.select(
        F.coalesce("c_waybill", "s_waybill").alias("waybill"),
        F.coalesce("c_carrier", F.lit(rules.default_carrier)).alias("carrier"),
        F.col("c_net_amount").alias("cost"),
        F.col("c_waybill").isNotNull().alias("has_cost"),
        is_return.alias("is_return"),
        F.col("c_zone").alias("zone"),
        F.col("c_kilos").alias("kilos"),
        F.col("c_service").alias("service"),
        F.coalesce("c_ship_date", F.col("s_created_at").cast("date")).alias("ship_date"),
        F.col("c_invoice_date").alias("invoice_date"),
        F.col("c_sender").alias("sender"),
        owner("seller_id").alias("seller_id"),
        owner("seller_name").alias("seller_name"),
        owner("payment_model").alias("payment_model"),
        F.when(is_return, F.lit(0).cast(AMOUNT))
        .otherwise(F.col("s_sale_price"))
        .alias("sale_price"),
        (F.col("s_waybill").isNotNull() | resolved).alias("in_system"),
        charge("overweight").alias("overweight"),
        charge("surcharge_cost").alias("surcharge_cost"),
    )


def _named(name: Column, exact_names: list[str], fragments: list[str]) -> Column:
    """Name equals one of the names or contains one of the fragments, in any case."""
    quoted = [f"^\\Q{n}\\E\\z" for n in exact_names] + [f"\\Q{f}\\E" for f in fragments]
    return name.rlike(f"(?iu){'|'.join(quoted)}") if quoted else F.lit(False)


def internal_match(name: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Whether a seller name is an internal account: exact, or by fragment; any case."""
    return _named(
        name, [n for n, _ in rules.internal_accounts], [f for f, _ in rules.internal_fragments]
    )


def internal_factor(name: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """1 + agreed margin of the first matching internal rule, else 1."""
    tests = [(_named(name, [n], []), m) for n, m in rules.internal_accounts]
    tests += [(_named(name, [], [f]), m) for f, m in rules.internal_fragments]
    factor = F.lit(1).cast("decimal(10,6)")
    for test, agreed in reversed(tests):
        factor = F.when(test, plus(agreed).cast("decimal(10,6)")).otherwise(factor)
    return factor


def charge_factor(name: Column, client_margin: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """1 + margin for extras: the agreed one of internal accounts, else client's or default."""
    margin = F.coalesce(client_margin, exact(rules.extra_margin)).cast("decimal(9,6)")
    return F.when(internal_match(name, rules), internal_factor(name, rules)).otherwise(
        plus(margin).cast("decimal(10,6)")
    )


def classify_account(
    base: DataFrame, credit_config: DataFrame, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """Adds account_type, method, client_margin and factor from the seller's configuration."""
    config = credit_config.select(
        F.col("seller_id").alias("_seller"),
        F.col("method").alias("_method"),
        F.col("margin").alias("client_margin"),
    )
    joined = base.join(config, F.col("seller_id") == F.col("_seller"), "left")
    account_type = (
        F.when(~F.col("in_system"), "not_in_system")
        .when(internal_match(F.col("seller_name"), rules), "internal")
        .when(F.col("payment_model") == rules.credit_model, "credit")
        .when(F.col("payment_model") == rules.prepaid_model, "prepaid")
        .otherwise("other")
    )
    return joined.select(
        *base.columns,
        account_type.alias("account_type"),
        normalise_method(F.col("_method")).alias("method"),
        "client_margin",
        charge_factor(F.col("seller_name"), F.col("client_margin"), rules).alias("factor"),
    )


def tariff_applies() -> Column:
    """Credit accounts with a non-automatic method are billed by tariff."""
    return (F.col("account_type") == "credit") & (F.col("method") != AUTOMATIC)


def already_billed() -> Column:
    return fine(or_zero(F.col("sale_price")) + F.col("overweight"))


def floor_price() -> Column:
    """Cost plus margin: the least a waybill should bring."""
    return fine(F.col("cost") * F.col("factor"))


def surcharge_price(rules: Rules = DEFAULT_RULES) -> Column:
    """Surcharge cost at the client's price; no margin configured counts as zero."""
    margin = F.coalesce("client_margin", F.lit(0)).cast("decimal(9,6)")
    charged = fine(F.col("surcharge_cost") * plus(margin) * plus(rules.vat))
    return F.when(tariff_applies(), charged).otherwise(F.lit(0).cast(FINE))


def extra_due() -> Column:
    """Shortfall of what was billed against the floor price, for costed non-tariff rows."""
    nothing = F.lit(0).cast(FINE)
    return (
        F.when(~F.col("has_cost"), nothing)
        .when(tariff_applies(), nothing)
        .otherwise(F.greatest(nothing, fine(floor_price() - already_billed())))
    )


def accrued_income(rules: Rules = DEFAULT_RULES) -> Column:
    """All a waybill should bring; NULL without a tariff, or when it is not in the system."""
    return (
        F.when(~F.col("has_cost"), already_billed())
        .when(F.col("account_type") == "internal", floor_price())
        .when(tariff_applies(), fine(F.col("tariff_price") + surcharge_price(rules)))
        .when(
            F.col("account_type").isin("credit", "prepaid", "other"),
            F.greatest(already_billed(), floor_price()),
        )
    )


def value(priced: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Adds the unrounded amounts: already_billed, surcharge_price, extra_raw, income_raw."""
    return priced.select(
        "*",
        already_billed().alias("already_billed"),
        surcharge_price(rules).alias("surcharge_price"),
        extra_due().alias("extra_raw"),
        accrued_income(rules).alias("income_raw"),
    )


def label_status(rules: Rules = DEFAULT_RULES) -> Column:
    return (
        F.when(~F.col("in_system"), "not_in_system")
        .when(~F.col("has_cost"), "billed_cost_pending")
        .when(F.col("account_type") == "internal", "internal")
        .when(tariff_applies() & F.col("tariff_price").isNull(), "credit_unbilled")
        .when(F.col("extra_raw") > exact(rules.extra_tolerance), "extra_due")
        .otherwise("billed_ok")
    )


def client_fallback(seller_name: Column, sender: Column) -> Column:
    return F.coalesce(seller_name, sender)


def label(valued: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The 20 result columns; only here are amounts rounded."""
    columns = {
        "client": client_fallback(F.col("seller_name"), F.col("sender")),
        "cost": cents(F.col("cost")),
        "overweight_billed": cents(F.col("overweight")),
        "extra": cents(F.col("extra_raw")),
        "surcharges": cents(F.col("surcharge_price")),
        "income": cents(F.col("income_raw")),
        "margin": cents(F.col("income_raw") - F.col("cost")),
        "status": label_status(rules),
        "ship_month": month_of(F.col("ship_date")),
        "invoice_month": month_of(F.col("invoice_date")),
    }
    result = valued.select(
        [columns.get(f.name, F.col(f.name)).alias(f.name) for f in RECONCILIATION]
    )
    return conform(result, RECONCILIATION)


def classified(
    invoices: DataFrame, shipments: DataFrame, overweight: DataFrame, surcharges: DataFrame,
    credit_config: DataFrame, rules: Rules = DEFAULT_RULES,
) -> DataFrame:
    base = attribute(invoices, shipments, overweight, surcharges, rules)
    return classify_account(base, credit_config, rules)


def valued(
    invoices: DataFrame, shipments: DataFrame, overweight: DataFrame, surcharges: DataFrame,
    credit_config: DataFrame, book: PriceBook, rules: Rules = DEFAULT_RULES,
) -> DataFrame:
    rows = classified(invoices, shipments, overweight, surcharges, credit_config, rules)
    return value(price(rows, book, rules=rules), rules)


def reconcile(
    invoices: DataFrame, shipments: DataFrame, overweight: DataFrame, surcharges: DataFrame,
    credit_config: DataFrame, book: PriceBook, rules: Rules = DEFAULT_RULES,
) -> DataFrame:
    """The whole chain; lazy."""
    return label(
        valued(invoices, shipments, overweight, surcharges, credit_config, book, rules), rules
    )
