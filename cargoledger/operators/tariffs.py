"""Client price lists: previews, matrices, versions and rate-card listings.

A price depends on the client and on a rate row's band (carrier, zone, service and kilos), not on its cost, which the book
answers. So a band is priced once per client, whatever the number of rate rows that share it. A price list has two forms:
by band, with the number of its rate rows, which grows with the clients; and by rate row, which is clients times rate rows
by nature and is spelled out last (`listed_rates`).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoledger.functions.labels import band_label, service_name, zone_order
from cargoledger.functions.money import FINE, RATE, cents, or_zero
from cargoledger.operators.pricing import (
    AUTOMATIC, PriceBook, flat_with_vat, normalise_method, price, validity_window,
)
from cargoledger.rules import DEFAULT_RULES, FLAT, METHODS, Rules
from cargoledger.schemas import TARIFF_VERSIONS, conform

# Columns of a price list.
PREVIEW_COLUMNS = (
    "seller_id", "carrier", "method", "service", "zone", "kilo_min", "kilo_max", "cost", "fuel",
    "price",
)
#: What a rate row's price depends on.
BAND = ("carrier", "zone", "service", "kilo_min", "kilo_max")
#: Columns of a price list by band; ``rates`` counts the rate rows of the band.
BAND_COLUMNS = tuple(c for c in PREVIEW_COLUMNS if c != "cost") + ("rates",)


def _tasks(df: DataFrame) -> int:
    """Tasks for a join that multiplies its rows: small inputs would be merged into one task by their bytes."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _current(cost_rates: DataFrame, as_of: date) -> DataFrame:
    return cost_rates.filter(validity_window(F.lit(as_of), F.col("valid_from"), F.col("valid_to")))


def _clients(credit_config: DataFrame, *more: str) -> DataFrame:
    return credit_config.select(
        "seller_id", *more,
        normalise_method(F.col("method")).alias("method"),
        F.col("margin").alias("client_margin"),
    ).filter(F.col("method").isin(*METHODS) & (F.col("method") != AUTOMATIC))


def priced_bands(
    clients: DataFrame,
    cost_rates: DataFrame,
    book: PriceBook,
    as_of: date,
    rules: Rules = DEFAULT_RULES,
) -> DataFrame:
    """`tariff_preview` by band: each band of the rate card once per client, with the number of its rate rows."""
    wanted = _clients(clients, "carrier").filter(F.col("method") != FLAT)
    bands = _current(cost_rates, as_of).groupBy(*BAND).agg(F.count(F.lit(1)).alias("rates"))
    kilo = F.coalesce("kilo_min", F.lit(0.0))
    # Clients dealt to tasks by a key of the join, so that no shuffle by the few carriers takes this one's place.
    tasks = _tasks(wanted)
    wanted = wanted.withColumn("_task", F.pmod(F.xxhash64("seller_id", "carrier"), F.lit(tasks)))
    bands = bands.withColumn("_task", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))))
    dealt = [df.repartition(tasks, "carrier", "_task") for df in (wanted, bands)]
    rows = dealt[0].join(dealt[1], ["carrier", "_task"])
    priced = price(rows, book, "exact_price", kilo=kilo, day=F.lit(as_of), fuel="fuel", rules=rules)
    return priced.withColumn("price", cents(F.col("exact_price"))).select(*BAND_COLUMNS)


def listed_rates(bands: DataFrame, cost_rates: DataFrame, as_of: date) -> DataFrame:
    """Price lists by band -> by rate row: every rate row valid on ``as_of`` of the bands, with its own cost."""
    rates = _current(cost_rates, as_of).select(*[F.col(c).alias(f"_rate_{c}") for c in (*BAND, "cost")])
    same = [F.col(c).eqNullSafe(F.col(f"_rate_{c}")) for c in BAND]
    rows = bands.repartition(_tasks(bands), "seller_id", *BAND).join(rates, same)
    own = {c: F.col(f"_rate_{c}") for c in (*BAND, "cost")}
    return rows.select(*[own.get(c, F.col(c)).alias(c) for c in PREVIEW_COLUMNS])


def tariff_preview(
    clients: DataFrame,
    cost_rates: DataFrame,
    book: PriceBook,
    as_of: date,
    rules: Rules = DEFAULT_RULES,
) -> DataFrame:
    """Rate-card rows valid on ``as_of``, priced for each client by margin, at the band start.

    ``clients`` has seller_id, carrier, method and margin: the price lists wanted. Automatic and
    flat clients have none here. The fuel shown is the one used in the price.
    """
    return listed_rates(priced_bands(clients, cost_rates, book, as_of, rules), cost_rates, as_of)


def price_lists_wanted(
    changed: DataFrame, client_carriers: DataFrame, changed_rates: DataFrame | None = None,
    clients: DataFrame | None = None,
) -> DataFrame:
    """The price lists (seller, carrier) that a change calls for, each once.

    ``changed`` are the sellers whose configuration changed, as `config_changed` returns them: all their carriers.
    With ``changed_rates`` (rate rows by carrier) also those of all ``clients`` who ship with such a carrier.
    """
    columns = ("seller_id", "carrier", "client", "method", "margin")
    wanted = changed.join(client_carriers, "seller_id").select(*columns)
    if changed_rates is not None:
        carriers = changed_rates.select("carrier").distinct()
        touched = clients.join(client_carriers.join(carriers, "carrier", "left_semi"), "seller_id")
        others = touched.select(*columns).join(wanted, ["seller_id", "carrier"], "left_anti")
        wanted = wanted.unionByName(others.select(*columns))
    return wanted.dropDuplicates(["seller_id", "carrier"])


def reprice(
    stored: DataFrame, wanted: DataFrame, cost_rates: DataFrame, book: PriceBook, as_of: date,
    rules: Rules = DEFAULT_RULES,
) -> DataFrame:
    """The stored price lists with those of ``wanted`` priced anew; no other list is priced or ranked.

    A list that is wanted but no longer has rows (its client went automatic, its rates ended) goes. The result has the
    form of ``stored``, by band or by rate row.
    """
    priced = priced_bands if "rates" in stored.columns else tariff_preview
    fresh = priced(wanted, cost_rates, book, as_of, rules)
    lists = wanted.select("seller_id", "carrier").distinct()
    return stored.join(lists, ["seller_id", "carrier"], "left_anti").select(stored.columns).unionByName(fresh)


def generated_tariffs(
    preview: DataFrame, wanted: DataFrame, as_of: date, created_at: str, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """A version row to be for each price list that has rows, in either form: what `tariff_version` numbers."""
    rows = F.sum("rates") if "rates" in preview.columns else F.count(F.lit(1))
    lists = preview.groupBy("seller_id", "carrier", "method").agg(rows.alias("bytes"))
    named = lists.join(wanted.select("seller_id", "carrier", "client", "margin"), ["seller_id", "carrier"])
    label = F.concat_ws("/", F.lit("tariffs"), F.col("seller_id"), F.col("carrier"))
    return named.select(
        "seller_id", "client", "carrier", "method", "margin",
        F.lit(rules.vat).cast(RATE).alias("vat"), F.lit(as_of).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
        label.alias("path"), F.concat(F.lit("tariff "), F.col("client")).alias("filename"),
        "bytes", F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
    )


def tariff_preview_flat(
    clients: DataFrame, flat_rates: DataFrame, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """Flat rates of the flat clients with VAT; no validity filter, no fuel."""
    wanted = _clients(clients).filter(F.col("method") == FLAT)
    rows = flat_rates.join(wanted.select("seller_id", "method"), "seller_id")
    return rows.select(
        "seller_id", "carrier", "method", F.lit(None).cast("string").alias("service"), "zone",
        "kilo_min", "kilo_max", F.lit(None).cast(FINE).alias("cost"),
        F.lit(0).cast(RATE).alias("fuel"),
        cents(flat_with_vat(F.col("price"), rules)).alias("price"),
    )


def ordered_zones(rows: DataFrame) -> list[str]:
    """Distinct zones, numeric ones first; few, and needed to name the matrix columns.

    More zones than Spark lets a pivot have is an error, as in any pivot.
    """
    limit = int(rows.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    zones = rows.select("zone").distinct().orderBy(*zone_order(F.col("zone")))
    found = [row["zone"] for row in zones.take(limit + 1)]
    if len(found) > limit:
        raise ValueError(f"more than {limit} zones")
    return found


def tariff_matrix(preview: DataFrame, zones: list[str] | None = None) -> DataFrame:
    """Price list, in either form, as a matrix: one row per client, carrier, service and band, one column per zone."""
    zones = ordered_zones(preview) if zones is None else zones
    keys = ("seller_id", "carrier", "service", "kilo_min", "kilo_max")
    matrix = preview.groupBy(*keys).pivot("zone", zones).agg(F.max("price"))
    return matrix.select(
        "seller_id", "carrier",
        service_name(F.col("carrier"), F.col("service")).alias("service_name"),
        "service", "kilo_min", "kilo_max",
        band_label(F.col("kilo_min"), F.col("kilo_max")).alias("band"),
        *[F.col(f"`{z}`").alias(f"zone_{z}") for z in zones],
    )


def fuel_today(fuel_rates: DataFrame, as_of: date, carrier: str | None = None) -> DataFrame:
    """Fuel shares valid on a day, by service."""
    rows = fuel_rates.filter(validity_window(F.lit(as_of), F.col("valid_from"), F.col("valid_to")))
    if carrier is not None:
        rows = rows.filter(F.col("carrier") == carrier)
    return rows.select(
        "carrier", F.coalesce("service", F.lit("")).alias("service"), "pct", "valid_from",
        "valid_to",
    ).orderBy("carrier", "service", F.col("valid_from").asc_nulls_last(), "pct")


def tariff_version(history: DataFrame, generated: DataFrame) -> DataFrame:
    """New version rows for a batch of generated price lists: one more than the seller's last.

    Several lists of one seller in a batch are numbered in order of creation.
    """
    last = history.groupBy("seller_id").agg(F.max("version").alias("_last"))
    order = Window.partitionBy("seller_id").orderBy("created_at", "carrier")
    numbered = generated.withColumn("_step", F.row_number().over(order))
    versioned = numbered.join(last, "seller_id", "left").withColumn(
        "version", (or_zero(F.col("_last")) + F.col("_step")).cast("int")
    )
    return conform(versioned, TARIFF_VERSIONS)


def tariff_history(
    versions: DataFrame, seller_id: int | None = None, version: int | None = None
) -> DataFrame:
    """Versions newest first; optionally of one seller, or one version of it."""
    if seller_id is not None:
        versions = versions.filter(F.col("seller_id") == seller_id)
    if version is not None:
        versions = versions.filter(F.col("version") == version)
    return versions.orderBy("seller_id", F.col("version").desc())


def list_rows(
    table: DataFrame, order: list[str], columns: list[str] | None = None, **filters: object
) -> DataFrame:
    """Rows of a configuration table by equality filters (None: any), sorted with NULLs last."""
    condition: Column = F.lit(True)
    for name, wanted in filters.items():
        if wanted is not None:
            condition = condition & (F.col(name) == wanted)
    rows = table.filter(condition).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return rows.select(*(columns or table.columns))


def services(
    invoices: DataFrame, cost_rates: DataFrame, carrier: str | None = None
) -> DataFrame:
    """Distinct non-empty services of a carrier's invoices and rate card, sorted."""
    both = invoices.select("carrier", "service").union(cost_rates.select("carrier", "service"))
    if carrier is not None:
        both = both.filter(F.col("carrier") == carrier)
    return both.filter(F.col("service") != "").distinct().orderBy("carrier", "service")
