"""Receivables ledger: charges, payments, balances and client statements.

Every change is a batch: a pure function from the old tables and a frame of changes to the new
table, written back by month partition.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoledger.functions.money import AMOUNT, CENTS, TOTAL, cents, exact, or_zero, plus, total
from cargoledger.operators.pricing import AUTOMATIC
from cargoledger.operators.reconcile import dedup_invoices
from cargoledger.rules import (
    APPROVED, DEFAULT_RULES, GENERATED, PAID, PARTIAL, SENT, Rules,
)
from cargoledger.schemas import CHARGE_ATTACHMENTS, CHARGES, CREDIT_CONFIG, PAYMENTS, conform
from cargoledger.sources.tables import replace_slice

KEY = ["seller_id", "month"]
INVOICE, EXTRA = "invoice", "extra"


def generate_charges(
    recon: DataFrame, month: str | None = None, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """Charges of a month, or of every month.

    Credit sellers owe the whole income; prepaid sellers only their extras, when those exceed
    the tolerance. Both come out of one aggregation.
    """
    rows = recon.filter(F.col("seller_id").isNotNull() & F.col("ship_month").isNotNull())
    if month is not None:
        rows = rows.filter(F.col("ship_month") == month)
    credit = F.col("account_type") == "credit"
    rows = rows.filter(
        (credit & F.col("income").isNotNull()) | (F.col("account_type") == "prepaid")
    )
    over = exact(rules.extra_tolerance)
    sums = rows.groupBy("seller_id", F.col("ship_month").alias("month"), "account_type").agg(
        F.min("client").alias("client"),
        F.count(F.lit(1)).alias("_lines"),
        F.count_if(F.col("extra") > over).alias("_extra_lines"),
        F.sum("income").alias("_income"),
        F.sum("extra").alias("_extra"),
    )
    kept = sums.filter(F.when(credit, F.col("_income") > 0).otherwise(F.col("_extra") > over))
    return kept.select(
        "seller_id", "client", "month", "account_type",
        F.when(credit, INVOICE).otherwise(EXTRA).alias("concept"),
        F.when(credit, F.col("_lines")).otherwise(F.col("_extra_lines")).alias("waybills"),
        cents(F.when(credit, F.col("_income")).otherwise(F.col("_extra"))).alias("amount"),
    )


def merge_charges(
    charges: DataFrame, generated: DataFrame, generated_at: str, month: str | None = None
) -> DataFrame:
    """Upsert generated charges; the cycle (status, payments, dates) of old ones survives.

    Charges of a generated month still in the initial state are dropped when their seller no
    longer has one. ``month`` None means every month was generated. A seller with a credit and
    a prepaid charge in one month keeps the smaller,
    since upserts run from the largest down.
    """
    fresh = (
        generated.withColumn(
            "_row", F.struct("client", "waybills", "amount", "account_type", "concept")
        )
        .groupBy(*[F.col(k).alias(f"_{k}") for k in KEY])
        .agg(F.min_by("_row", F.struct("amount", "account_type")).alias("_new"))
    )
    same = [charges[k] == fresh[f"_{k}"] for k in KEY]
    both = charges.join(fresh, same, "full_outer")
    is_new, is_old = F.col("_seller_id").isNotNull(), F.col("month").isNotNull()
    in_scope = F.lit(True) if month is None else F.col("month") == month
    stale = ~is_new & in_scope & (F.col("status") == GENERATED)
    rewritten = ("client", "waybills", "amount", "account_type", "concept")
    first = {"status": F.lit(GENERATED), "generated_at": F.lit(generated_at), "paid_amount": F.lit(0)}
    columns = {k: F.coalesce(k, f"_{k}") for k in KEY}
    columns |= {c: F.when(is_new, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in rewritten}
    columns |= {
        c: F.when(is_old, F.col(c)).otherwise(v.cast(CHARGES[c].dataType))
        for c, v in first.items()
    }
    merged = both.filter(~F.coalesce(stale, F.lit(False))).select(
        [columns.get(f.name, F.col(f.name)).alias(f.name) for f in CHARGES]
    )
    return conform(merged, CHARGES)


def charge_totals(charges: DataFrame, month: str | None = None) -> DataFrame:
    """Sellers and amount per month."""
    if month is not None:
        charges = charges.filter(F.col("month") == month)
    return charges.groupBy("month").agg(
        F.count(F.lit(1)).alias("sellers"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast(TOTAL).alias("total_amount"),
    )


def paid_by_charge(payments: DataFrame) -> DataFrame:
    return payments.groupBy(*KEY).agg(F.sum("amount").cast(CENTS).alias("paid"))


def list_charges(
    charges: DataFrame, payments: DataFrame, attachments: DataFrame, as_of: date,
    month: str | None = None,
) -> DataFrame:
    """Ledger with paid amount, balance, days overdue and whether a document is attached."""
    if month is not None:
        charges = charges.filter(F.col("month") == month)
    attached = attachments.select(*KEY).distinct().withColumn("_attached", F.lit(True))
    rows = charges.join(paid_by_charge(payments), KEY, "left").join(attached, KEY, "left")
    today = F.lit(as_of)
    overdue = (F.col("status") != PAID) & (today > F.col("due_date"))
    return (
        rows.withColumn("paid", or_zero(F.col("paid")).cast(CENTS))
        .select(
            *KEY, "client", "account_type", "concept", "waybills", "amount", "paid",
            (F.col("amount") - F.col("paid")).cast(CENTS).alias("balance"),
            "status", "sent_date", "due_date",
            F.when(overdue, F.datediff(today, F.col("due_date")))
            .otherwise(F.lit(0))
            .alias("days_overdue"),
            F.coalesce("_attached", F.lit(False)).alias("has_attachment"),
        )
        .orderBy(
            F.col("balance").desc_nulls_last(), F.col("amount").desc_nulls_last(), *KEY
        )
    )


def send_charges(
    charges: DataFrame, sent: DataFrame, credit_config: DataFrame, as_of: date,
    rules: Rules = DEFAULT_RULES,
) -> DataFrame:
    """Mark charges as sent: due after the seller's credit days (0 or none: the default).

    ``sent`` has the key and sent_on (NULL: ``as_of``); of several dates the last one counts.
    """
    changes = sent.groupBy(*KEY).agg(
        F.coalesce(F.max("sent_on"), F.lit(as_of)).alias("_sent_on"), F.lit(True).alias("_sent")
    )
    days = credit_config.select("seller_id", F.nullif("credit_days", F.lit(0)).alias("_days"))
    rows = charges.join(changes, KEY, "left").join(days, "seller_id", "left")
    term = F.coalesce("_days", F.lit(rules.credit_days))
    status = (
        F.when(F.col("status") == PAID, PAID)
        .when(or_zero(F.col("paid_amount")) > 0, PARTIAL)
        .otherwise(SENT)
    )
    columns = {
        "status": F.when(F.col("_sent"), status).otherwise(F.col("status")),
        "sent_date": F.coalesce("_sent_on", "sent_date"),
        "due_date": F.when(F.col("_sent"), F.date_add("_sent_on", term)).otherwise(
            F.col("due_date")
        ),
    }
    return conform(
        rows.select([columns.get(f.name, F.col(f.name)).alias(f.name) for f in CHARGES]), CHARGES
    )


def recompute_charges(
    charges: DataFrame, payments: DataFrame, touched: DataFrame | None = None,
    rules: Rules = DEFAULT_RULES,
) -> DataFrame:
    """Paid amount and status from the payments, for the touched charges or for all.

    Within the tolerance of the total is paid; something paid is partial; nothing paid keeps a
    state that needs no payment, else falls back to sent.
    """
    rows = charges.join(
        paid_by_charge(payments).withColumnRenamed("paid", "_paid"), KEY, "left"
    )
    if touched is None:
        rows = rows.withColumn("_touched", F.lit(True))
    else:
        marks = touched.select(*KEY).distinct().withColumn("_touched", F.lit(True))
        rows = rows.join(marks, KEY, "left")
    paid = or_zero(F.col("_paid")).cast(CENTS)
    status = (
        F.when(paid >= or_zero(F.col("amount")) - exact(rules.payment_tolerance), PAID)
        .when(paid > 0, PARTIAL)
        .when(F.col("status").isin(GENERATED, SENT, APPROVED), F.col("status"))
        .otherwise(SENT)
    )
    columns = {
        "paid_amount": F.when(F.col("_touched"), paid).otherwise(F.col("paid_amount")),
        "status": F.when(F.col("_touched"), status).otherwise(F.col("status")),
    }
    return conform(
        rows.select([columns.get(f.name, F.col(f.name)).alias(f.name) for f in CHARGES]), CHARGES
    )


def record_payments(
    payments: DataFrame, batch: DataFrame, charges: DataFrame, rules: Rules = DEFAULT_RULES
) -> tuple[DataFrame, DataFrame]:
    """Payments with the batch appended, and the charges it touches recomputed."""
    after = payments.unionByName(conform(batch, PAYMENTS))
    return after, recompute_charges(charges, after, batch, rules)


def charge_balance(charges: DataFrame, payments: DataFrame) -> DataFrame:
    """Amount, paid and balance of each charge."""
    paid = or_zero(F.col("paid")).cast(CENTS)
    return charges.join(paid_by_charge(payments), KEY, "left").select(
        *KEY, "status", "amount", paid.alias("paid"),
        (or_zero(F.col("amount")) - paid).cast(CENTS).alias("balance"),
    )


def payment_history(
    payments: DataFrame, seller_id: int | None = None, month: str | None = None
) -> DataFrame:
    """Payments by date, of one charge or of all."""
    if seller_id is not None:
        payments = payments.filter(F.col("seller_id") == seller_id)
    if month is not None:
        payments = payments.filter(F.col("month") == month)
    return payments.orderBy(*KEY, F.col("paid_on").asc_nulls_last(), "recorded_at", "payment_id")


def void_payments(
    payments: DataFrame, voided: DataFrame, charges: DataFrame, rules: Rules = DEFAULT_RULES
) -> tuple[DataFrame, DataFrame]:
    """Payments without the voided ones (by id and key), and their charges recomputed."""
    after = payments.join(voided.select("payment_id", *KEY), ["payment_id", *KEY], "left_anti")
    after = after.select(payments.columns)
    return after, recompute_charges(charges, after, voided, rules)


def override_status(charges: DataFrame, changes: DataFrame) -> DataFrame:
    """Set the status of the listed charges."""
    wanted = changes.groupBy(*KEY).agg(F.max("status").alias("_status"))
    rows = charges.join(wanted, KEY, "left")
    status = F.coalesce("_status", "status").alias("status")
    return rows.select([status if c == "status" else F.col(c) for c in charges.columns])


def _lines(
    charges: DataFrame, recon: DataFrame, how: str, rules: Rules
) -> DataFrame:
    """Reconciled rows of each seller and month with the concept of their charge."""
    concept = charges.select(
        F.col("seller_id").alias("_seller"), F.col("month").alias("_month"),
        F.col("concept").alias("_concept"),
    )
    keys = (F.col("seller_id") == F.col("_seller")) & (F.col("ship_month") == F.col("_month"))
    rows = recon.filter(F.col("seller_id").isNotNull()).join(concept, keys, how)
    is_extra = F.coalesce(F.col("_concept") == EXTRA, F.lit(False))
    return rows.withColumn("_is_extra", is_extra).filter(
        ~F.col("_is_extra") | (F.col("extra") > exact(rules.extra_tolerance))
    )


def charge_detail(
    charges: DataFrame, recon: DataFrame, invoices: DataFrame, limit: int | None = None,
    rules: Rules = DEFAULT_RULES,
) -> DataFrame:
    """The lines of each charge by amount, with their invoice line; with ``limit`` its largest."""
    amount = F.when(F.col("_is_extra"), F.col("extra")).otherwise(F.col("income"))
    lines = _lines(charges, recon, "inner", rules).select(
        "seller_id", F.col("ship_month").alias("month"), "waybill", F.col("is_return").alias("returned"),
        amount.alias("amount"),
    )
    first = dedup_invoices(invoices, "destination").select(
        "waybill", "ship_date", "service", "destination", "kilos", "zone"
    )
    order = Window.partitionBy(*KEY).orderBy(F.col("amount").desc_nulls_last(), "waybill")
    placed = lines.join(first, "waybill").withColumn("position", F.row_number().over(order))
    if limit is not None:
        placed = placed.filter(F.col("position") <= limit)
    return placed.select(
        *KEY, "position", "waybill", "ship_date", "service", "destination", "kilos", "zone",
        F.col("returned").alias("is_return"), "amount",
    )


def _split_tax(amount: Column, rules: Rules) -> tuple[Column, Column]:
    """Subtotal and tax of a total that includes VAT."""
    subtotal = cents(amount / (1 + rules.vat))
    return subtotal, cents(amount - subtotal)


def _statement_lines(charges: DataFrame, recon: DataFrame, rules: Rules) -> DataFrame:
    """Base price of each costed waybill; its carrier is that of its first invoice line."""
    base = F.col("income") - or_zero(F.col("surcharges"))
    amount = F.when(F.col("_is_extra"), F.col("extra")).otherwise(base)
    costed = _lines(charges, recon, "left", rules).filter(F.col("has_cost"))
    return costed.select(
        "seller_id", F.col("ship_month").alias("month"), "waybill",
        F.col("carrier").alias("_carrier"), or_zero(amount).cast(CENTS).alias("total"),
    )


def client_statement(
    charges: DataFrame, recon: DataFrame, invoices: DataFrame, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """Statement lines per seller, month and carrier: base price split into subtotal and tax.

    Surcharges are separate lines (``statement_surcharges``), so they are taken out here.
    """
    lines = _statement_lines(charges, recon, rules).drop("_carrier")
    shown = ("origin", "destination", "pieces", "recipient")
    first = dedup_invoices(invoices, *shown)
    subtotal, tax = _split_tax(F.col("total"), rules)
    return lines.join(first, "waybill").select(
        *KEY, "carrier", "waybill", "reference", "service", "origin", "destination", "zone",
        "pieces", "kilos", F.ceil("kilos").cast("int").alias("billable_kilos"), "ship_date",
        subtotal.alias("freight"), F.lit(0).cast(CENTS).alias("other_costs"),
        subtotal.alias("subtotal"), tax.alias("tax"), "total",
        F.lit(0).cast(CENTS).alias("insurance"),
        F.lit(int(rules.vat * 100)).alias("tax_pct"), F.lit("MXN").alias("currency"),
        F.lit(1).alias("exchange_rate"), "sender", "recipient",
    )


def statement_surcharges(
    charges: DataFrame, recon: DataFrame, surcharges: DataFrame, credit_config: DataFrame,
    rules: Rules = DEFAULT_RULES,
) -> DataFrame:
    """Surcharge lines per seller, month, carrier and concept, at the client's price.

    None for charges of extras, nor for carriers without a waybill line in the statement. Costs
    are summed per waybill before they meet the reconciliation.
    """
    costs = surcharges.groupBy("waybill", F.col("carrier").alias("_carrier"), "concept").agg(
        F.sum("amount").cast(AMOUNT).alias("_cost")
    )
    rows = _lines(charges, recon, "left", rules).filter(~F.col("_is_extra"))
    summed = (
        rows.select("seller_id", F.col("ship_month").alias("month"), "waybill")
        .join(costs, "waybill")
        .groupBy(*KEY, F.col("_carrier").alias("carrier"), "concept")
        .agg(F.sum("_cost").cast(CENTS).alias("_cost"))
    )
    config = credit_config.select("seller_id", F.col("margin").alias("_margin"))
    margin = or_zero(F.col("_margin")).cast("decimal(9,6)")
    price = cents(or_zero(F.col("_cost")) * plus(margin) * plus(rules.vat))
    present = (
        _statement_lines(charges, recon, rules)
        .select(*KEY, F.col("_carrier").alias("carrier"))
        .distinct()
    )
    lines = (
        summed.join(config, "seller_id", "left")
        .withColumn("total", price)
        .filter(F.col("total") != 0)
        .join(present, [*KEY, "carrier"], "left_semi")
    )
    subtotal, tax = _split_tax(F.col("total"), rules)
    return lines.select(
        *KEY, "carrier", "concept", subtotal.alias("subtotal"), tax.alias("tax"), "total"
    )


def statement_totals(
    charges: DataFrame, recon: DataFrame, surcharge_lines: DataFrame, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """Total per seller, month and carrier, surcharge lines included; reads no invoices."""
    base = _statement_lines(charges, recon, rules).select(
        *KEY, F.col("_carrier").alias("carrier"), "total"
    )
    both = base.unionByName(surcharge_lines.select(*KEY, "carrier", "total"))
    return both.groupBy(*KEY, "carrier").agg(total("total").alias("total"))


def update_credit_config(config: DataFrame, changes: DataFrame) -> DataFrame:
    """Merge sent fields over stored ones; a field not sent keeps its value.

    ``changes`` has one row per seller: client, method, margin, credit_days, and the flags
    margin_sent and credit_days_sent, since a sent NULL clears. Value and note are cleared.
    """
    new = changes.select([F.col(c).alias(f"_{c}") for c in changes.columns])
    rows = config.withColumn("_stored", F.lit(True)).join(
        new, F.col("seller_id") == F.col("_seller_id"), "full_outer"
    )
    changed = F.col("_seller_id").isNotNull()
    sent_or_stored = lambda c: F.when(F.col(f"_{c}_sent"), F.col(f"_{c}")).otherwise(F.col(c))
    default = F.when(F.col("_stored").isNull(), F.lit(AUTOMATIC)).otherwise(F.col("method"))
    merged = {
        "client": F.coalesce(F.nullif("_client", F.lit("")), "client"),
        "method": F.coalesce(F.nullif("_method", F.lit("")), default),
        "margin": sent_or_stored("margin"),
        "credit_days": sent_or_stored("credit_days"),
        "value": F.lit(None),
        "note": F.lit(None),
    }
    columns = {
        c: F.when(changed, v.cast(CREDIT_CONFIG[c].dataType)).otherwise(F.col(c))
        for c, v in merged.items()
    }
    columns["seller_id"] = F.coalesce("seller_id", "_seller_id")
    return conform(
        rows.select([columns[f.name].alias(f.name) for f in CREDIT_CONFIG]), CREDIT_CONFIG
    )


def config_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sellers to re-price: method or margin changed, method not automatic, margin set."""
    old = before.select(
        "seller_id", F.col("method").alias("_method"), F.col("margin").alias("_margin")
    )
    rows = after.join(old, "seller_id", "left")
    differs = ~F.col("method").eqNullSafe(F.col("_method")) | (
        or_zero(F.col("margin")) != or_zero(F.col("_margin"))
    )
    manual = ~F.col("method").eqNullSafe(F.lit(AUTOMATIC)) & F.col("margin").isNotNull()
    return rows.filter(differs & manual).select("seller_id", "client", "method", "margin")


def set_attachment(attachments: DataFrame, batch: DataFrame) -> DataFrame:
    """One document per seller and month; the latest of the batch replaces what is stored."""
    rows = conform(batch, CHARGE_ATTACHMENTS)
    entry = F.struct("filename", "path", "uploaded_at")
    order = F.struct("uploaded_at", "filename", "path")
    latest = (
        rows.groupBy(*KEY)
        .agg(F.max_by(entry, order).alias("_entry"))
        .select(*KEY, "_entry.filename", "_entry.path", "_entry.uploaded_at")
    )
    return replace_slice(conform(attachments, CHARGE_ATTACHMENTS), latest, KEY)
