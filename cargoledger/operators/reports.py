"""Reports over the reconciliation result.

Each report is a partial (map-side) aggregation followed by one shuffle of the partial rows,
so hot clients and months cost nothing extra. Reports read a written result, partitioned by
ship month, where a month range prunes directories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoledger.functions.money import CENTS, TOTAL, or_zero, percent, total
from cargoledger.operators.pricing import AUTOMATIC
from cargoledger.schemas import PERIODS, conform
from cargoledger.sources.tables import replace_slice

OPEN_STATUSES = ("credit_unbilled", "extra_due")
REALISED_MISSING = "SIN"  # month text that means "no month"


def month_range_filter(
    df: DataFrame, since: str | None = None, until: str | None = None, column: str = "ship_month"
) -> DataFrame:
    """Optional inclusive bounds on ``YYYY-MM`` text; empty means unbounded."""
    if since:
        df = df.filter(F.col(column) >= since)
    if until:
        df = df.filter(F.col(column) <= until)
    return df


def _count() -> Column:
    return F.count(F.lit(1))


def _costed(amount: Column) -> Column:
    return F.when(F.col("cost").isNotNull(), amount).otherwise(F.lit(0).cast(CENTS))


def _receivable() -> Column:
    """What is still open on a row, by its status."""
    return (
        F.when(F.col("status") == "extra_due", or_zero(F.col("extra")))
        .when(F.col("status") == "credit_unbilled", F.col("cost") - or_zero(F.col("income")))
        .otherwise(F.lit(0).cast(CENTS))
        .cast(CENTS)
    )


def _to_accrue() -> Column:
    """Billed, but the carrier has not invoiced the cost yet."""
    return F.when(F.col("cost").isNull(), or_zero(F.col("income"))).otherwise(
        F.lit(0).cast(CENTS)
    )


def _profit() -> Column:
    return (F.col("income") - F.col("cost")).cast(CENTS)


def _when_set(amount: Column) -> Column:
    return F.coalesce(amount, F.lit(0).cast(CENTS))


def _margin() -> Column:
    return (F.sum("income") - F.sum("cost")).cast(TOTAL)


def _returns() -> list[Column]:
    return [
        F.sum(F.when(F.col("is_return"), F.col("cost")).otherwise(F.lit(0).cast(CENTS)))
        .cast(TOTAL)
        .alias("return_cost"),
        F.count_if("is_return").alias("return_waybills"),
    ]


def summary_by_status(recon: DataFrame) -> DataFrame:
    return (
        recon.groupBy("status")
        .agg(
            _count().alias("waybills"), total("cost").alias("cost"),
            total("income").alias("income"), _margin().alias("margin"),
        )
        .orderBy(F.col("cost").desc_nulls_last(), "status")
    )


def kpis(recon: DataFrame) -> DataFrame:
    """One row; income and margin are realised, i.e. of rows that have a cost."""
    return recon.agg(
        _count().alias("waybills"),
        total("cost").alias("cost"),
        total(_costed(F.col("income"))).alias("income"),
        total(_when_set(_profit())).alias("margin"),
        total(_receivable()).alias("receivable"),
        total(_to_accrue()).alias("to_accrue"),
    )


def prepaid_clients(
    recon: DataFrame, recharges: DataFrame, since: str | None = None, until: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Prepaid accounts by client, costliest first.

    The recharge shown is the sum over the client's distinct sellers. Rows are first reduced to
    one per client and seller, so the recharges join a small frame.
    """
    rows = month_range_filter(recon.filter(F.col("account_type") == "prepaid"), since, until)
    sums = ("cost", "income", "extra", "overweight", "return_cost")
    by_seller = rows.groupBy("client", "seller_id").agg(
        _count().alias("waybills"), total("cost").alias("cost"), total("income").alias("income"),
        total(or_zero(F.col("extra"))).alias("extra"),
        total("overweight_billed").alias("overweight"), *_returns(),
    )
    recharged = by_seller.join(recharges.select("seller_id", "recharges"), "seller_id", "left")
    by_client = recharged.groupBy("client").agg(
        F.sum("waybills").alias("waybills"),
        *[F.sum(c).cast(TOTAL).alias(c) for c in sums],
        F.sum("return_waybills").alias("return_waybills"),
        F.sum("recharges").cast(TOTAL).alias("recharges"),
    )
    margin = (F.col("income") - F.col("cost")).cast(TOTAL)
    report = by_client.select(
        "client", "waybills", "cost", "income", margin.alias("margin"),
        percent(F.col("income") - F.col("cost"), F.col("cost")).alias("margin_pct"),
        "extra", "overweight", "return_cost", "return_waybills", "recharges",
    ).orderBy(F.col("cost").desc_nulls_last(), F.col("client").asc_nulls_last())
    return report if limit is None else report.limit(limit)


def credit_clients(
    recon: DataFrame, since: str | None = None, until: str | None = None, limit: int | None = None
) -> DataFrame:
    rows = month_range_filter(recon.filter(F.col("account_type") == "credit"), since, until)
    unbilled = F.when(F.col("income").isNull(), F.col("cost")).otherwise(F.lit(0).cast(CENTS))
    report = (
        rows.groupBy("client")
        .agg(
            _count().alias("waybills"), total("cost").alias("cost"),
            total(or_zero(F.col("income"))).alias("billed"),
            total(unbilled).alias("unbilled_cost"),
            total(or_zero(F.col("surcharges"))).alias("surcharges"),
            total("overweight_billed").alias("overweight"), *_returns(),
        )
        .orderBy(F.col("cost").desc_nulls_last(), F.col("client").asc_nulls_last())
    )
    return report if limit is None else report.limit(limit)


def match_waybills(
    recon: DataFrame, *, account_type: str | None = None, status: str | None = None,
    client: str | None = None, waybill: str | None = None, since: str | None = None,
    until: str | None = None,
) -> DataFrame:
    """Rows passing the given filters; client and waybill match anywhere, in any case."""
    if account_type:
        recon = recon.filter(F.col("account_type") == account_type)
    if status:
        recon = recon.filter(F.col("status") == status)
    if client:
        recon = recon.filter(F.col("client").ilike(f"%{client}%"))
    if waybill:
        recon = recon.filter(F.col("waybill").ilike(f"%{waybill}%"))
    return month_range_filter(recon, since, until)


SEARCH_ORDER = ("cost", "waybill")


def after_waybill(cost: Column, waybill: Column) -> Column:
    """Rows behind a given one in the order of a search: cost falling, NULL last, then waybill."""
    same, none = F.col("cost").eqNullSafe(cost) & (F.col("waybill") > waybill), F.col("cost").isNull()
    return same | (cost.isNotNull() & (none | (F.col("cost") < cost)))


def waybill_page(matches: DataFrame, limit: int, after: tuple | None = None) -> DataFrame:
    """The next page of matching waybills, costliest first, behind the last one (cost, waybill) of the page before.

    A distributed top-k of ``limit`` rows per task, however deep the page.
    """
    if after is not None:
        cost, waybill = after
        matches = matches.filter(after_waybill(F.lit(cost).cast(CENTS), F.lit(waybill)))
    return _shown(matches.orderBy(F.col("cost").desc_nulls_last(), "waybill").limit(limit))


def search_waybills(
    recon: DataFrame, *, limit: int = 100, offset: int = 0, **filters: str | None
) -> DataFrame:
    """One page of matching waybills, costliest first: a distributed top-k."""
    page = (
        match_waybills(recon, **filters)
        .orderBy(F.col("cost").desc_nulls_last(), "waybill")
        .offset(offset)
        .limit(limit)
    )
    return _shown(page)


def _shown(page: DataFrame) -> DataFrame:
    return page.select(
        "waybill", "carrier", "client", "account_type", "status", "is_return", "cost",
        "sale_price", F.col("overweight_billed").alias("overweight"),
        or_zero(F.col("extra")).cast(CENTS).alias("extra"),
        or_zero(F.col("surcharges")).cast(CENTS).alias("surcharges"),
        "income", "margin", "ship_month",
    )


def search_total(recon: DataFrame, **filters: str | None) -> DataFrame:
    """Number of waybills a search matches, over all its pages."""
    return match_waybills(recon, **filters).agg(_count().alias("total"))


def receivable(
    recon: DataFrame, since: str | None = None, until: str | None = None, limit: int | None = None
) -> DataFrame:
    """Open amounts by client and status."""
    rows = month_range_filter(recon.filter(F.col("status").isin(*OPEN_STATUSES)), since, until)
    report = (
        rows.groupBy("client", "status")
        .agg(
            _count().alias("waybills"), total("cost").alias("cost"),
            total(_receivable()).alias("amount_due"),
        )
        .orderBy(
            F.col("amount_due").desc_nulls_last(), F.col("client").asc_nulls_last(), "status"
        )
    )
    return report if limit is None else report.limit(limit)


def close_months(recon: DataFrame, periods: DataFrame) -> DataFrame:
    """Totals by ship month with its period state, newest first."""
    rows = recon.filter(F.col("ship_month").isNotNull() & (F.col("ship_month") != REALISED_MISSING))
    months = rows.groupBy(F.col("ship_month").alias("month")).agg(
        _count().alias("waybills"), total("cost").alias("cost"),
        total(_costed(F.col("income"))).alias("income"),
        total(_when_set(_profit())).alias("profit"),
        total(_receivable()).alias("receivable"),
        total(_to_accrue()).alias("to_accrue"),
    )
    return with_period_state(months, periods)


def with_period_state(months: DataFrame, periods: DataFrame) -> DataFrame:
    """Month totals with the state of their period, open by default, newest first."""
    state = periods.select("month", F.col("status").alias("_status"), "closed_at")
    return (
        months.join(state, "month", "left")
        .withColumn("status", F.coalesce("_status", F.lit("open")))
        .drop("_status")
        .orderBy(F.col("month").desc())
    )


def close_detail(recon: DataFrame, month: str, limit: int | None = None) -> DataFrame:
    """A month by client and carrier, costliest first."""
    report = (
        recon.filter(F.col("ship_month") == month)
        .groupBy("client", "carrier")
        .agg(
            _count().alias("waybills"), total("cost").alias("cost"),
            total(or_zero(F.col("income"))).alias("billed"),
            (F.sum(or_zero(F.col("income"))) - F.sum(or_zero(F.col("cost"))))
            .cast(TOTAL)
            .alias("margin"),
        )
        .orderBy(
            F.col("cost").desc_nulls_last(), F.col("client").asc_nulls_last(), "carrier"
        )
    )
    return report if limit is None else report.limit(limit)


def month_snapshot(recon: DataFrame, month: str, closed_at: str) -> DataFrame:
    """Closed-period row of a month; income counts rows without cost, unlike ``kpis``."""
    row = (
        recon.filter(F.col("ship_month") == month)
        .agg(
            total("cost").alias("cost"), total("income").alias("income"),
            total(_when_set(_profit())).alias("profit"),
        )
        .select(
            F.lit(month).alias("month"), F.lit("closed").alias("status"), "cost", "income",
            "profit", F.lit(closed_at).alias("closed_at"),
        )
    )
    return conform(row, PERIODS)


def close_month(recon: DataFrame, periods: DataFrame, month: str, closed_at: str) -> DataFrame:
    """Periods after closing a month: its snapshot replaces any earlier one."""
    return replace_slice(
        conform(periods, PERIODS), month_snapshot(recon, month, closed_at), ["month"]
    )


def reopen_month(periods: DataFrame, months: DataFrame) -> DataFrame:
    """Periods without the given months."""
    return periods.join(months.select("month").distinct(), "month", "left_anti").select(
        periods.columns
    )


def _credit_sellers(recon: DataFrame) -> DataFrame:
    return (
        recon.filter(F.col("account_type") == "credit")
        .groupBy("seller_id")
        .agg(
            F.min("client").alias("client"), _count().alias("waybills"),
            total("cost").alias("cost"),
        )
    )


def credit_config_overview(recon: DataFrame, credit_config: DataFrame) -> DataFrame:
    """Credit sellers with their configuration, costliest first."""
    config = credit_config.select("seller_id", "method", "value", "note")
    return (
        _credit_sellers(recon)
        .join(config, "seller_id", "left")
        .orderBy(F.col("cost").desc_nulls_last(), F.col("seller_id").asc_nulls_last())
    )


def tariff_clients(
    recon: DataFrame, credit_config: DataFrame, flat_rates: DataFrame
) -> DataFrame:
    """Credit sellers with method, margin, credit days and number of flat-rate rows."""
    config = credit_config.select("seller_id", "method", "margin", "credit_days")
    rates = flat_rates.groupBy("seller_id").agg(_count().alias("flat_rows"))
    return (
        _credit_sellers(recon)
        .join(config, "seller_id", "left")
        .join(rates, "seller_id", "left")
        .withColumn("method", F.coalesce("method", F.lit(AUTOMATIC)))
        .withColumn("flat_rows", F.coalesce("flat_rows", F.lit(0)))
        .orderBy(F.col("cost").desc_nulls_last(), F.col("seller_id").asc_nulls_last())
    )


def collections_worklist(recon: DataFrame, limit: int | None = None) -> DataFrame:
    """Prepaid and credit clients billed at least 1 below cost, largest shortfall first."""
    billed = F.sum(or_zero(F.col("income")))
    report = (
        recon.filter(F.col("account_type").isin("prepaid", "credit"))
        .groupBy("client")
        .agg(
            F.min("account_type").alias("account_type"), _count().alias("waybills"),
            total("cost").alias("cost"), billed.cast(TOTAL).alias("billed"),
            (F.sum("cost") - billed).cast(TOTAL).alias("shortfall"),
            percent(billed, F.sum("cost")).alias("billed_pct"),
        )
        .filter(F.col("shortfall") > 1)
        .orderBy(F.col("shortfall").desc(), F.col("client").asc_nulls_last())
    )
    return report if limit is None else report.limit(limit)


def by_client(recon: DataFrame) -> DataFrame:
    return (
        recon.groupBy("client")
        .agg(
            F.min("account_type").alias("account_type"), _count().alias("waybills"),
            total("cost").alias("cost"), total("income").alias("income"),
            _margin().alias("margin"),
            percent(F.sum("income") - F.sum("cost"), F.sum("cost")).alias("margin_pct"),
        )
        .orderBy(F.col("cost").desc_nulls_last(), F.col("client").asc_nulls_last())
    )


def by_ship_month(recon: DataFrame) -> DataFrame:
    return (
        recon.groupBy("ship_month")
        .agg(
            _count().alias("waybills"), total("cost").alias("cost"),
            total("income").alias("income"), _margin().alias("margin"),
        )
        .orderBy(F.col("ship_month").asc_nulls_last())
    )


def actionable(recon: DataFrame) -> DataFrame:
    """Cost not covered by income, by client and open status."""
    return (
        recon.filter(F.col("status").isin(*OPEN_STATUSES))
        .groupBy("client", "status")
        .agg(
            _count().alias("waybills"), total("cost").alias("carrier_cost"),
            (F.sum("cost") - F.sum(or_zero(F.col("income")))).cast(TOTAL).alias("uncollected"),
        )
        .orderBy(
            F.col("uncollected").desc_nulls_last(), F.col("client").asc_nulls_last(), "status"
        )
    )


def report_bundle(recon: DataFrame) -> dict[str, DataFrame]:
    """The four finance reports, written together by ``tables.write_reports``."""
    return {
        "summary_by_status": summary_by_status(recon),
        "by_client": by_client(recon),
        "by_ship_month": by_ship_month(recon),
        "actionable": actionable(recon),
    }


