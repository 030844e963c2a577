"""Client prices from dated, weight-banded rate cards.

A lookup picks one of several matching rate rows: by service exactness, then by band start or
newest validity. Ranking matches per shipment would cost a sort of the whole shipment side, so
the (small) cards are compiled instead: overlapping rate rows become disjoint (kilo, date)
cells that already hold the winning value (`cells.py`), and the general rates of a carrier are folded into
the cells of each service it knows. Every shipment then matches at most one cell, so a lookup is one left join that
neither multiplies nor sorts shipments; a price takes two.

Cards change rarely: a book is compiled once, stored, and read by every run. No join here is
hinted. The planner sees the true size of a stored card and broadcasts it only below its own
threshold; a larger card is joined by shuffle, where adaptive execution splits the hot keys.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoledger.functions.money import AMOUNT, FINE, RATE, fine, plus
from cargoledger.operators.cells import compile_cells, ranked_rows
from cargoledger.rules import (
    AUTOMATIC, DEFAULT_RULES, FLAT, LEGACY_FLAT, MARGIN_GLOBAL, MARGIN_KILO, MARGIN_METHODS, MARGIN_ZONE, Rules,
)
from cargoledger.sources.tables import stored

# What an absent bound stands for.
FIRST_DAY, LAST_DAY = "1900-01-01", "2999-01-01"
KILO_FLOOR, KILO_CEILING = -1e12, 1e12


def first_day(valid_from: Column) -> Column:
    return F.coalesce(valid_from, F.lit(FIRST_DAY).cast("date"))


def last_day(valid_to: Column) -> Column:
    return F.coalesce(valid_to, F.lit(LAST_DAY).cast("date"))


def validity_window(day: Column, valid_from: Column, valid_to: Column) -> Column:
    """Whether ``day`` lies in the window; both ends included, NULL ends are open."""
    return day.between(first_day(valid_from), last_day(valid_to))


def kilo_start(kilo_min: Column) -> Column:
    return F.coalesce(kilo_min, F.lit(KILO_FLOOR))


def kilo_end(kilo_max: Column) -> Column:
    return F.coalesce(kilo_max, F.lit(KILO_CEILING))


def kilo_band(kilo: Column, kilo_min: Column, kilo_max: Column) -> Column:
    """Whether ``kilo`` lies in the band; start included, end excluded."""
    return (kilo >= kilo_start(kilo_min)) & (kilo < kilo_end(kilo_max))


def normalise_method(method: Column) -> Column:
    """Configured method; the legacy name means flat, none means automatic."""
    return F.when(method == LEGACY_FLAT, F.lit(FLAT)).otherwise(
        F.coalesce(method, F.lit(AUTOMATIC))
    )


def nulls_last(c: Column) -> list[Column]:
    """Sort fields for a struct ordering: ascending with NULL after every value."""
    return [c.isNull(), c]


def _ranges(by_kilo: bool, by_date: bool) -> dict[str, tuple[Column, Column]]:
    """Bounds of rate rows, end excluded; a validity's last day counts, so its end is the day after."""
    kilo = (kilo_start(F.col("kilo_min")), kilo_end(F.col("kilo_max")))
    day = (first_day(F.col("valid_from")), F.date_add(last_day(F.col("valid_to")), 1))
    return ({"kilo": kilo} if by_kilo else {}) | ({"day": day} if by_date else {})


def compile_card(
    card: DataFrame,
    keys: dict[str, Column],
    value: Column,
    order: list[Column],
    *,
    by_kilo: bool,
    by_date: bool,
) -> DataFrame:
    """Rate rows -> disjoint cells (keys, kilo_low/high, day_low/high, value).

    ``order`` ranks overlapping rows, best first; equal ranks fall to the least value.
    """
    ranges = _ranges(by_kilo, by_date)
    rows = ranked_rows(card, keys, ranges, order, value)
    cells = compile_cells({"best": rows}, list(keys), list(ranges))
    kind = card.select(value.alias("value")).schema["value"].dataType
    return cells.withColumn("value", F.col("best.value").cast(kind)).drop("best")


def service_code(service: Column) -> Column:
    """Service of a rate row or shipment; the empty one is the general one."""
    return F.coalesce(service, F.lit(""))


def known_services(*rates: DataFrame) -> DataFrame:
    """Every service that some rate row of a carrier names."""
    both = reduce(DataFrame.union, [r.select("carrier", service_code(F.col("service")).alias("service")) for r in rates])
    return both.filter(F.col("service") != "").distinct()


def folded(rates: DataFrame, services: DataFrame) -> DataFrame:
    """Rate rows by the service they price: a service's own rows, and the general rows once for each known service of
    the carrier and once for all others (the empty service). ``fallback`` tells a general row under a known service."""
    rates = rates.withColumn("service", service_code(F.col("service")))
    general = rates.filter(F.col("service") == "")
    copies = general.drop("service").join(services, "carrier")
    same = [F.col(c) for c in rates.columns]
    return rates.select(*same, F.lit(False).alias("fallback")).union(copies.select(*same, F.lit(True)))


def _with_known(cells: DataFrame, services: DataFrame) -> DataFrame:
    """Cells of the empty service name the services that have cells of their own."""
    known = services.groupBy("carrier").agg(F.sort_array(F.collect_set("service")).alias("known"))
    known = known.withColumn("service", F.lit(""))
    return cells.join(known, ["carrier", "service"], "left")


def _cost_order() -> list[Column]:
    """Rate rows of one service: its own before a fallback, then the lowest band start."""
    return [F.col("fallback"), *nulls_last(F.col("kilo_min"))]


def _fuel_order() -> list[Column]:
    return [F.col("fallback"), F.col("valid_from").isNull(), -F.unix_date(F.col("valid_from"))]


def cost_card(cost_rates: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """Lowest band start wins; a band without start comes last."""
    services = known_services(cost_rates) if services is None else services
    keys = {k: F.col(k) for k in ("carrier", "zone", "service")}
    rows = folded(cost_rates, services)
    return _with_known(compile_card(rows, keys, F.col("cost"), _cost_order(), by_kilo=True, by_date=True), services)


def fuel_card(fuel_rates: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """Newest validity start wins; a rate without start comes last."""
    services = known_services(fuel_rates) if services is None else services
    keys = {k: F.col(k) for k in ("carrier", "service")}
    rows = folded(fuel_rates, services)
    return _with_known(compile_card(rows, keys, F.col("pct"), _fuel_order(), by_kilo=False, by_date=True), services)


def tariff_card(cost_rates: DataFrame, fuel_rates: DataFrame) -> DataFrame:
    """Cost and fuel share in one card, by carrier, zone and service: one cell answers both."""
    services = known_services(cost_rates, fuel_rates)
    keys = {k: F.col(k) for k in ("carrier", "zone", "service")}
    places = cost_rates.select("carrier", "zone").distinct()
    fuel = folded(fuel_rates, services).join(places, "carrier")
    every_kilo = {"kilo": (F.lit(KILO_FLOOR), F.lit(KILO_CEILING))}
    both = compile_cells(
        {
            "cost": ranked_rows(folded(cost_rates, services), keys, _ranges(True, True), _cost_order(), F.col("cost")),
            "fuel": ranked_rows(fuel, keys, every_kilo | _ranges(False, True), _fuel_order(), F.col("pct")),
        },
        list(keys), ["kilo", "day"],
    ).filter("cost is not null")
    cost, pct = cost_rates.schema["cost"].dataType, fuel_rates.schema["pct"].dataType
    values = {"cost": F.col("cost.value").cast(cost), "fuel": F.col("fuel.value").cast(pct)}
    return _with_known(both.withColumns(values), services).withColumn("spread", F.lit(PROBED))


def zone_margin_card(zone_margins: DataFrame) -> DataFrame:
    """One margin per seller and zone (the least, should there be several)."""
    return zone_margins.groupBy("seller_id", "zone").agg(F.min("margin").alias("value"))


def kilo_margin_card(kilo_margins: DataFrame) -> DataFrame:
    return compile_card(
        kilo_margins,
        {"seller_id": F.col("seller_id")},
        F.col("margin"),
        nulls_last(F.col("kilo_min")),
        by_kilo=True,
        by_date=False,
    )


def flat_card(flat_rates: DataFrame) -> DataFrame:
    return compile_card(
        flat_rates,
        {k: F.col(k) for k in ("seller_id", "carrier", "zone")},
        F.col("price"),
        nulls_last(F.col("kilo_min")),
        by_kilo=True,
        by_date=True,
    )


#: What a card does not look at stands in its cells and its probes as these.
ANY = ""
ANY_KILO, ANY_DAY = 0.0, "2000-01-01"
#: Part of the key in every cell that `price` probes. Rows that need no probe carry other numbers.
PROBED = 0


def seller_card(zone_margin: DataFrame, kilo_margin: DataFrame, flat: DataFrame) -> DataFrame:
    """The three cards by seller as one: (seller_id, method, carrier, zone), ranges and value."""
    every = {
        "carrier": F.lit(ANY), "zone": F.lit(ANY),
        "kilo_low": F.lit(KILO_FLOOR), "kilo_high": F.lit(KILO_CEILING),
        "day_low": F.lit(FIRST_DAY).cast("date"), "day_high": F.lit(LAST_DAY).cast("date"),
    }

    def part(cells: DataFrame, method: str) -> DataFrame:
        columns = [F.col(c) if c in cells.columns else every[c].alias(c) for c in every]
        return cells.select("seller_id", F.lit(method).alias("method"), *columns, F.col("value").cast(AMOUNT).alias("value"))

    zone = part(zone_margin.filter(F.col("zone").isNotNull()), MARGIN_ZONE)
    cells = zone.unionByName(part(kilo_margin, MARGIN_KILO)).unionByName(part(flat, FLAT))
    return cells.filter(F.col("seller_id").isNotNull()).withColumn("spread", F.lit(PROBED))


@dataclass(frozen=True)
class PriceBook:
    """Compiled rate cards; ``tariff`` and ``seller`` join the others for `price`."""

    cost: DataFrame
    fuel: DataFrame
    zone_margin: DataFrame
    kilo_margin: DataFrame
    flat: DataFrame
    tariff: DataFrame
    seller: DataFrame


def price_book(
    cost_rates: DataFrame,
    fuel_rates: DataFrame,
    zone_margins: DataFrame,
    kilo_margins: DataFrame,
    flat_rates: DataFrame,
) -> PriceBook:
    zone, kilo, flat = zone_margin_card(zone_margins), kilo_margin_card(kilo_margins), flat_card(flat_rates)
    return PriceBook(
        cost=cost_card(cost_rates),
        fuel=fuel_card(fuel_rates),
        zone_margin=zone,
        kilo_margin=kilo,
        flat=flat,
        tariff=tariff_card(cost_rates, fuel_rates),
        seller=seller_card(zone, kilo, flat),
    )


def store_price_book(book: PriceBook, folder: str) -> PriceBook:
    """Write every card under ``folder`` and return the book that reads them; the seller card is made of stored ones."""
    names = [f.name for f in fields(book) if f.name != "seller"]

    def store(name: str, card: DataFrame) -> DataFrame:
        return stored(card, f"{folder.rstrip('/')}/{name}")

    with ThreadPoolExecutor(len(names)) as pool:  # small independent jobs, submitted together
        cards = dict(zip(names, pool.map(lambda n: store(n, getattr(book, n)), names), strict=True))
    seller = seller_card(cards["zone_margin"], cards["kilo_margin"], cards["flat"])
    return PriceBook(**cards, seller=store("seller", seller))


def _attach(
    df: DataFrame,
    card: DataFrame,
    keys: dict[str, Column],
    names: dict[str, str],
    kilo: Column | None = None,
    day: Column | None = None,
    service: Column | None = None,
) -> DataFrame:
    """Left join the one cell that holds (keys, service, kilo, day); adds its columns ``names`` under new names.

    A known service has cells of its own; all others take those of the empty service. The service is a residual of the
    join by the other keys, so both come from one probe.
    """
    at = lambda c: F.col(f"_cell_{c}")
    cells = card.toDF(*[f"_cell_{c}" for c in card.columns])
    match = [probe == at(key) for key, probe in keys.items()]
    if service is not None:
        known = F.coalesce(F.array_contains(at("known"), service_code(service)), F.lit(False))
        match.append((at("service") == service_code(service)) | ((at("service") == "") & ~known))
    if kilo is not None:
        match += [kilo >= at("kilo_low"), kilo < at("kilo_high")]
    if day is not None:
        match += [day >= at("day_low"), day < at("day_high")]
    joined = df.join(cells, reduce(and_, match), "left")
    joined = joined.withColumns({new: at(old) for old, new in names.items()})
    return joined.drop(*cells.columns)


def lookup_cost(
    df: DataFrame, book: PriceBook, name: str = "unit_cost", *, carrier: Column | None = None,
    zone: Column | None = None, service: Column | None = None, kilo: Column | None = None,
    day: Column | None = None,
) -> DataFrame:
    """Card cost by carrier, zone, kilo and day; exact service first, else general, else NULL."""
    keys = {
        "carrier": F.col("carrier") if carrier is None else carrier,
        "zone": F.col("zone") if zone is None else zone,
    }
    return _attach(
        df, book.cost, keys, {"value": name},
        service=F.col("service") if service is None else service,
        kilo=F.col("kilos") if kilo is None else kilo,
        day=F.col("ship_date") if day is None else day,
    )


def lookup_fuel(
    df: DataFrame, book: PriceBook, name: str = "fuel", *, carrier: Column | None = None,
    service: Column | None = None, day: Column | None = None,
) -> DataFrame:
    """Fuel share by carrier and day; exact service first, else general, else zero."""
    found = _attach(
        df, book.fuel, {"carrier": F.col("carrier") if carrier is None else carrier}, {"value": name},
        service=F.col("service") if service is None else service,
        day=F.col("ship_date") if day is None else day,
    )
    return found.withColumn(name, F.coalesce(name, F.lit(0)).cast(RATE))


def _margin_or_zero(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(name, F.lit(0)).cast(RATE))


def lookup_zone_margin(
    df: DataFrame, book: PriceBook, name: str = "zone_margin", *, seller: Column | None = None,
    zone: Column | None = None,
) -> DataFrame:
    keys = {
        "seller_id": F.col("seller_id") if seller is None else seller,
        "zone": F.col("zone") if zone is None else zone,
    }
    return _margin_or_zero(_attach(df, book.zone_margin, keys, {"value": name}), name)


def lookup_kilo_margin(
    df: DataFrame, book: PriceBook, name: str = "kilo_margin", *, seller: Column | None = None,
    kilo: Column | None = None,
) -> DataFrame:
    keys = {"seller_id": F.col("seller_id") if seller is None else seller}
    found = _attach(
        df, book.kilo_margin, keys, {"value": name}, kilo=F.col("kilos") if kilo is None else kilo
    )
    return _margin_or_zero(found, name)


def lookup_flat(
    df: DataFrame, book: PriceBook, name: str = "flat_price", *, seller: Column | None = None,
    kilo: Column | None = None, day: Column | None = None,
) -> DataFrame:
    keys = {
        "seller_id": F.col("seller_id") if seller is None else seller,
        "carrier": F.col("carrier"),
        "zone": F.col("zone"),
    }
    return _attach(
        df, book.flat, keys, {"value": name},
        kilo=F.col("kilos") if kilo is None else kilo,
        day=F.col("ship_date") if day is None else day,
    )


def flat_with_vat(price: Column, rules: Rules) -> Column:
    return fine(price * plus(rules.vat))


def _spread(needed: Column, *row: str) -> Column:
    """`PROBED` for rows that probe a card; others get numbers no card has: they are dealt out evenly and meet nothing."""
    return F.when(needed, F.lit(PROBED)).otherwise(1 + F.pmod(F.xxhash64(*row), F.lit(1 << 20)).cast("int"))


def price(
    df: DataFrame,
    book: PriceBook,
    name: str = "tariff_price",
    *,
    kilo: Column | None = None,
    day: Column | None = None,
    fuel: str | None = None,
    rules: Rules = DEFAULT_RULES,
) -> DataFrame:
    """Client price of each row by its ``method``; unrounded. ``fuel`` names a column for the fuel share used.

    Reads carrier, zone, service, kilos, ship_date, seller_id, method and client_margin. Two probes: one cell by carrier, zone
    and service holds cost and fuel, one by seller and method the margin or the flat price. No key is ever NULL: rows
    that need no probe, or lack a part of its key, are spread.
    """
    method = F.col("method")
    on_margin = method.isin(*MARGIN_METHODS)
    kilo = F.col("kilos") if kilo is None else kilo
    day = F.col("ship_date") if day is None else day
    row = ("seller_id", "carrier", "zone", "service", "kilos", "ship_date")
    row = tuple(c for c in row if c in df.columns)

    placed = F.col("carrier").isNotNull() & F.col("zone").isNotNull()
    rated = F.coalesce(on_margin & placed, F.lit(False))
    keys = {"carrier": service_code(F.col("carrier")), "zone": service_code(F.col("zone"))}
    rows = _attach(
        df, book.tariff, {**keys, "spread": _spread(rated, *row)},
        {"cost": "_cost", "fuel": "_fuel"}, service=F.col("service"), kilo=kilo, day=day,
    )

    is_flat, by_zone, by_kilo = (method == m for m in (FLAT, MARGIN_ZONE, MARGIN_KILO))
    whole = (is_flat & placed) | (by_zone & F.col("zone").isNotNull()) | by_kilo
    owned = F.coalesce(whole & F.col("seller_id").isNotNull(), F.lit(False))
    keys = {
        "seller_id": F.coalesce(F.col("seller_id"), F.lit(0).cast("long")),
        "method": F.coalesce(method, F.lit(ANY)),
        "carrier": F.when(is_flat, service_code(F.col("carrier"))).otherwise(F.lit(ANY)),
        "zone": F.when(is_flat | by_zone, service_code(F.col("zone"))).otherwise(F.lit(ANY)),
        "spread": _spread(owned, *row),
    }
    rows = _attach(
        rows, book.seller, keys, {"value": "_own"},
        kilo=F.when(by_zone, F.lit(ANY_KILO)).otherwise(kilo),
        day=F.when(is_flat, day).otherwise(F.lit(ANY_DAY).cast("date")),
    )
    share = F.coalesce("_fuel", F.lit(0)).cast(RATE)
    margin = F.when(method == MARGIN_GLOBAL, F.col("client_margin")).otherwise(F.col("_own"))
    margin = F.coalesce(margin, F.lit(0)).cast(RATE)
    factor = (plus(share) * plus(margin) * plus(rules.vat)).cast("decimal(18,14)")
    value = (
        F.when(is_flat, flat_with_vat(F.col("_own"), rules))
        .when(on_margin, fine(F.col("_cost") * factor))
        .otherwise(F.lit(None).cast(FINE))
    )
    shown = {name: value} | ({fuel: share} if fuel else {})
    return rows.withColumns(shown).drop("_cost", "_fuel", "_own")
