"""Registered queries: each operator over the whole of its domain tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoledger import schemas
from cargoledger.functions import cleaners, labels
from cargoledger.functions.money import AMOUNT, cents
from cargoledger.operators import pricing, receivables, reconcile, reports, rollups, search, tariffs
from cargoledger.plans.domain import Domain
from cargoledger.rules import DEFAULT_RULES
from cargoledger.sources import carriers, mirror, surcharges, tables

AS_OF = date(1999, 3, 15)
MONTH = "1999-01"
CLOSED_AT = "2002-02-01 08:00:00"

Query = Callable[["Workspace"], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def present(df: DataFrame) -> DataFrame:
    """Exact decimals as doubles, days and times as text: types every client can compare."""

    def shown(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return c.alias(f.name)

    return df.select([shown(f) for f in df.schema])


# Written once per session and data folder: the compiled price book and the result.
_STORED: dict[tuple[str, str, str], object] = {}


class Workspace(Domain):
    """Domain tables plus the frames several queries share."""

    def _stored(self, name: str, build: Callable[[str], Any]) -> Any:
        """A table written once per session and data folder, then read by every query."""
        session = self.spark.sparkContext.applicationId
        key = (session, self.folder, name)
        if key not in _STORED:
            data = self.folder.strip("/").replace("/", "_")
            _STORED[key] = build(f"{tables.shared_folder(self.spark)}/{session}/{data}/{name}")
            tables.free_shuffles(self.spark)  # before the next step writes its own
        return _STORED[key]

    def scratch(self, name: str, df: DataFrame) -> DataFrame:
        """A frame written once per session and data folder, and read back."""
        return self._stored(name, lambda path: tables.stored(df, path))

    @cached_property
    def compiled(self) -> pricing.PriceBook:
        return pricing.price_book(
            self.cost_rates, self.fuel_rates, self.zone_margins, self.kilo_margins,
            self.flat_rates,
        )

    @property
    def book(self) -> pricing.PriceBook:
        return self._stored("book", lambda path: pricing.store_price_book(self.compiled, path))

    def book_for(self, card: str) -> pricing.PriceBook:
        """The book for a lookup in one card: only that card is stored, the others stay plans that nothing runs."""
        if (self.spark.sparkContext.applicationId, self.folder, "book") in _STORED:
            return self.book
        return replace(self.compiled, **{card: self.scratch(f"book-{card}", getattr(self.compiled, card))})

    @property
    def facts(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        return self.carrier_invoices, self.shipments, self.overweight, self.surcharges

    @cached_property
    def attributed(self) -> DataFrame:
        return reconcile.attribute(*self.facts)

    @cached_property
    def classified(self) -> DataFrame:
        return reconcile.classified(*self.facts, self.credit_config)

    @cached_property
    def valued(self) -> DataFrame:
        return reconcile.valued(*self.facts, self.credit_config, self.book)

    @cached_property
    def reconciled(self) -> DataFrame:
        return reconcile.reconcile(*self.facts, self.credit_config, self.book)

    @property
    def recon(self) -> DataFrame:
        """The written result table the reports read."""
        return self._stored(
            "reconciliation", lambda path: tables.write_reconciliation(self.reconciled, path)
        )

    @property
    def rolled(self) -> DataFrame:
        """The stored roll-up of the result."""
        return self._stored("rollup", lambda path: rollups.write_rollup(self.recon, path))

    def postings(self, column: str) -> DataFrame:
        """Stored trigram postings of a column of the result."""
        return self._stored(f"{column}-postings", lambda path: search.store_postings(self.recon, column, path))

    def new_folder(self, name: str) -> str:
        """A path of its own for a query that changes a stored table."""
        session = self.spark.sparkContext.applicationId
        return f"{tables.shared_folder(self.spark)}/{session}/{name}-{uuid.uuid4().hex[:12]}"

    @property
    def variant_files(self) -> str:
        """Carrier files with two header orders; the second lacks columns the first has."""

        def write(path: str) -> str:
            raw = self.raw_dhl
            shown = [F.col(f"`{f.name}`").cast("string").alias(f.name) for f in raw.schema]
            odd = F.col("`No. Factura`").endswith("1") | F.col("`No. Factura`").endswith("7")
            fewer = [c for c in reversed(raw.columns) if c not in ("Seguro", "Zona", "YB")]
            text = raw.select(shown)
            for name, part in (("a", text.where(~odd)), ("b", text.where(odd).select([F.col(f"`{c}`") for c in fewer]))):
                part.write.mode("overwrite").csv(
                    f"{path}/{name}", header=True, ignoreLeadingWhiteSpace=False,
                    ignoreTrailingWhiteSpace=False, emptyValue="",
                )
            return f"{path}/*"

        return self._stored("variants", write)

    @cached_property
    def lines(self) -> DataFrame:
        """First invoice lines with the columns the rate lookups read."""
        return reconcile.dedup_invoices(self.carrier_invoices).select(
            "waybill", "carrier", "zone", "service", "kilos", "ship_date"
        )

    @cached_property
    def priced(self) -> DataFrame:
        columns = (
            "waybill", "carrier", "zone", "service", "kilos", "ship_date", "seller_id", "method",
            "client_margin",
        )
        return pricing.price(self.classified.select(*columns), self.book)

    @cached_property
    def config_after(self) -> DataFrame:
        return receivables.update_credit_config(self.credit_config, self.config_changes)

    @cached_property
    def wanted_lists(self) -> DataFrame:
        """The price lists that a batch of configuration changes calls for."""
        changed = receivables.config_changed(self.credit_config, self.config_after)
        return tariffs.price_lists_wanted(changed, self.client_carriers)

    @property
    def preview_bands(self) -> DataFrame:
        """The lists wanted, priced once by band and stored for all that read them."""
        build = lambda: tariffs.priced_bands(self.wanted_lists, self.cost_rates, self.book, AS_OF)
        return self._stored("preview", lambda path: tables.stored(build(), path))

    @property
    def earlier_lists(self) -> DataFrame:
        """All clients' price lists before the changes, by band."""

        def build() -> DataFrame:
            clients = self.credit_config.join(self.client_carriers, "seller_id")
            return tariffs.priced_bands(clients, self.cost_rates, self.book, AS_OF)

        return self._stored("price-lists", lambda path: tables.stored(build(), path))

    @cached_property
    def generated(self) -> DataFrame:
        return receivables.generate_charges(self.recon)

    @cached_property
    def statement(self) -> DataFrame:
        return receivables.client_statement(self.charges, self.recon, self.carrier_invoices)

    @cached_property
    def surcharge_lines(self) -> DataFrame:
        return receivables.statement_surcharges(
            self.charges, self.recon, self.surcharges, self.credit_config
        )


# --- sources --------------------------------------------------------------------------------
@query
def ingest_dhl(w: Workspace) -> DataFrame:
    return carriers.normalise_invoices(w.raw_dhl, "dhl", "dhl.csv")


@query
def ingest_fedex(w: Workspace) -> DataFrame:
    return carriers.normalise_invoices(w.raw_fedex, "fedex", "fedex.csv")


@query
def ingest_paquete_express(w: Workspace) -> DataFrame:
    return carriers.normalise_invoices(w.raw_paquete_express, "paquete_express", "px.csv")


@query
def ingest_second_account(w: Workspace) -> DataFrame:
    return carriers.normalise_invoices(w.raw_paquete_express, "paquete_express_2", "px2.csv")


@query
def ingest_client_invoices(w: Workspace) -> DataFrame:
    return carriers.normalise_client_invoices(w.raw_client_invoices, "clients.csv")


@query
def ingest_surcharges(w: Workspace) -> DataFrame:
    """All carriers, each by its columns in the mapping table."""
    return surcharges.ingest_mapped(
        {
            "dhl": w.raw_dhl, "fedex": w.raw_fedex, "paquete_express": w.raw_paquete_express,
            "paquete_express_2": w.raw_paquete_express,
        },
        w.surcharge_map,
    )


@query
def ingest_header_variants(w: Workspace) -> DataFrame:
    """One load of files whose columns differ in order and number, written from the raw table."""
    return carriers.read_invoices(w.spark, f"{w.variant_files}/*.csv", "dhl", source_file="dhl.csv")


@query
def canonical_union(w: Workspace) -> DataFrame:
    return carriers.canonical_union(
        [ingest_dhl(w), ingest_fedex(w), ingest_paquete_express(w), ingest_second_account(w)]
    )


@query
def clean_text(w: Workspace) -> DataFrame:
    return w.raw_dhl.select(
        cleaners.clean_text(F.col("`No.De Guia`")).alias("waybill"),
        cleaners.clean_text(F.col("Referencia")).alias("reference"),
        cleaners.clean_text(F.col("Remitente")).alias("sender"),
        cleaners.clean_text(F.col("Destinatario")).alias("recipient"),
    )


@query
def clean_number(w: Workspace) -> DataFrame:
    return w.raw_dhl.select(
        cleaners.clean_number(F.col("`Importe Neto`"), AMOUNT).alias("net_amount"),
        cleaners.clean_number(F.col("Kilos")).alias("kilos"),
        cleaners.clean_number(F.col("YB"), AMOUNT).alias("surcharge"),
    )


@query
def clean_number_or_null(w: Workspace) -> DataFrame:
    return w.raw_dhl.select(
        cleaners.clean_number_or_null(F.col("`Importe Neto`"), AMOUNT).alias("net_amount"),
        cleaners.clean_integer_or_null(F.col("Pza")).alias("pieces"),
    )


@query
def clean_date(w: Workspace) -> DataFrame:
    raw = w.raw_paquete_express
    return raw.select(
        cleaners.clean_date(F.col("`Fecha envío`")).alias("ship_date"),
        cleaners.clean_date(F.col("`Fecha factura`")).alias("invoice_date"),
    )


@query
def clean_pieces(w: Workspace) -> DataFrame:
    return w.raw_dhl.select(
        F.col("Pza").alias("cell"), cleaners.clean_pieces(F.col("Pza")).alias("pieces")
    )


@query
def drop_blank_rows(w: Workspace) -> DataFrame:
    kept = carriers.drop_blank_rows(w.raw_fedex, "Guia")
    return kept.select(F.col("Guia").alias("cell"), F.col("Cuenta").alias("account"))


@query
def detect_return(w: Workspace) -> DataFrame:
    reference = cleaners.clean_text(F.col("Referencia"))
    return w.raw_dhl.select(
        reference.alias("reference"), cleaners.detect_return(reference).alias("is_return")
    )


@query
def source_file_tag(w: Workspace) -> DataFrame:
    tagged = carriers.with_source_file(w.scan("lineitem"))
    return tagged.select("l_orderkey", "l_linenumber", "source_file")


@query
def latest_shipment(w: Workspace) -> DataFrame:
    names = DEFAULT_RULES.warehouse_carriers.values()
    return mirror.latest_shipment(w.shipment_facts, names, "1995-01-01")


@query
def dedup_by_id(w: Workspace) -> DataFrame:
    tie = mirror.SHIPMENT_TIES
    latest = mirror.dedup_by_id(w.shipment_facts, "shipment_id", "version", *tie)
    return latest.select("shipment_id", "version", "waybill", *tie[:-2])


@query
def merge_shipments(w: Workspace) -> DataFrame:
    """The mirror after two batches: facts up to a middle version, then the later ones and, late, every fourth earlier one again."""
    facts = w.shipment_facts
    low, high = facts.agg(F.min("version"), F.max("version")).first()
    middle = F.lit(low + (high - low) / 2 if low else None).cast(facts.schema["version"].dataType)
    early = facts.filter(F.col("version") <= middle)
    state = mirror.dedup_by_id(early, "shipment_id", "version", *mirror.SHIPMENT_TIES)
    state = w.scratch("shipment-state", state)
    before = w.scratch("shipment-mirror", mirror.latest_shipment(state))
    late = facts.filter((F.col("version") > middle) | (F.col("shipment_id") % 4 == 0))
    return mirror.merge_shipments(state, before, late, lambda df: w.scratch("shipment-changes", df))[1]


@query
def overweight_rollup(w: Workspace) -> DataFrame:
    return mirror.overweight_rollup(w.wallet_transactions)


@query
def recharge_rollup(w: Workspace) -> DataFrame:
    return mirror.recharge_rollup(w.recharge_facts, "2024-01-01")


@query
def append_batch(w: Workspace) -> DataFrame:
    return tables.append_batch(w.payments, w.new_payments)


@query
def replace_slice(w: Workspace) -> DataFrame:
    renewed = w.carrier_invoices.select(
        "carrier", "waybill", F.lit("Reloaded").alias("concept"),
        F.col("surcharges").alias("amount"),
    ).filter(F.col("carrier").isin("dhl", "fedex"))
    return tables.replace_slice(w.surcharges, renewed, ["carrier"])


@query
def replace_all(w: Workspace) -> DataFrame:
    return tables.replace_all(w.shipments, mirror.latest_shipment(w.shipment_facts))


@query
def replace_stored_slice(w: Workspace) -> DataFrame:
    """As `replace_slice`, on a table stored by carrier: two carriers get new rows, one is emptied."""
    renewed = w.carrier_invoices.select(
        "carrier", "waybill", F.lit("Reloaded").alias("concept"), F.col("surcharges").alias("amount")
    ).filter(F.col("carrier").isin("dhl", "fedex"))
    path, kind = w.new_folder("surcharges"), schemas.SURCHARGES
    tables.write_overwrite(w.surcharges, path, ["carrier"])
    named = w.spark.createDataFrame([("dhl",), ("fedex",), ("paquete_express",)], "carrier string")
    return tables.upsert_slices(
        w.spark, path, kind, ["carrier"], named, lambda old: schemas.conform(renewed, kind), w.new_folder("staging")
    )


@query
def load_log(w: Workspace) -> DataFrame:
    """The load is written once and counted on the way."""
    _, rows = tables.counted_write(w.shipments, w.new_folder("shipments"))
    entry = tables.counted_entry(w.spark, rows, "shipments", "multi", "1995-01-01", CLOSED_AT)
    return tables.load_log(w.earlier_loads, entry)


@query
def evolve_schema(w: Workspace) -> DataFrame:
    old = w.credit_config.drop("margin", "credit_days")
    return schemas.evolve_schema(old, schemas.CREDIT_CONFIG)


@query
def write_reconciliation(w: Workspace) -> DataFrame:
    return w.recon


@query
def report_bundle(w: Workspace) -> DataFrame:
    """Row counts and cost totals of the four reports written together."""
    parts = []
    for name, report in reports.report_bundle(w.recon).items():
        cost = "carrier_cost" if name == "actionable" else "cost"
        parts.append(
            report.agg(
                F.count(F.lit(1)).alias("row_count"), F.sum("waybills").alias("waybills"),
                F.sum(cost).alias("cost"),
            ).select(F.lit(name).alias("report"), "row_count", "waybills", "cost")
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# --- reconciliation -------------------------------------------------------------------------
@query
def dedup_invoices(w: Workspace) -> DataFrame:
    return reconcile.dedup_invoices(w.carrier_invoices)


@query
def return_origin(w: Workspace) -> DataFrame:
    return w.carrier_invoices.select(
        "waybill", "reference",
        cleaners.return_origin(F.col("is_return"), F.col("reference")).alias("origin"),
    )


@query
def overweight_by_waybill(w: Workspace) -> DataFrame:
    return reconcile.overweight_by_waybill(w.overweight)


@query
def surcharge_by_waybill(w: Workspace) -> DataFrame:
    return reconcile.surcharge_by_waybill(w.surcharges)


@query
def attribute(w: Workspace) -> DataFrame:
    return w.attributed


@query
def internal_match(w: Workspace) -> DataFrame:
    return w.shipments.select(
        "waybill", "seller_name",
        reconcile.internal_match(F.col("seller_name")).alias("is_internal"),
    )


@query
def internal_factor(w: Workspace) -> DataFrame:
    return w.shipments.select(
        "waybill", reconcile.internal_factor(F.col("seller_name")).alias("factor")
    )


@query
def normalise_method(w: Workspace) -> DataFrame:
    return w.credit_config.select(
        "seller_id", pricing.normalise_method(F.col("method")).alias("method")
    )


@query
def classify_account(w: Workspace) -> DataFrame:
    return w.classified.select("waybill", "seller_id", "account_type", "method")


@query
def charge_factor(w: Workspace) -> DataFrame:
    return w.classified.select("waybill", "client_margin", "factor")


@query
def already_billed(w: Workspace) -> DataFrame:
    return w.classified.select("waybill", reconcile.already_billed().alias("already_billed"))


@query
def surcharge_price(w: Workspace) -> DataFrame:
    return w.classified.select("waybill", reconcile.surcharge_price().alias("surcharge_price"))


@query
def extra_due(w: Workspace) -> DataFrame:
    return w.classified.select("waybill", reconcile.extra_due().alias("extra_raw"))


@query
def accrued_income(w: Workspace) -> DataFrame:
    return w.valued.select("waybill", "income_raw")


@query
def margin(w: Workspace) -> DataFrame:
    return w.valued.select("waybill", cents(F.col("income_raw") - F.col("cost")).alias("margin"))


@query
def label_status(w: Workspace) -> DataFrame:
    return w.valued.select("waybill", reconcile.label_status().alias("status"))


@query
def accounting_months(w: Workspace) -> DataFrame:
    return w.attributed.select(
        "waybill", cleaners.month_of(F.col("ship_date")).alias("ship_month"),
        cleaners.month_of(F.col("invoice_date")).alias("invoice_month"),
    )


@query
def client_fallback(w: Workspace) -> DataFrame:
    client = reconcile.client_fallback(F.col("seller_name"), F.col("sender"))
    return w.attributed.select("waybill", client.alias("client"))


@query
def reconcile_waybills(w: Workspace) -> DataFrame:
    return w.reconciled


QUERIES["reconcile"] = QUERIES.pop("reconcile_waybills")


# --- pricing --------------------------------------------------------------------------------
@query
def validity_window(w: Workspace) -> DataFrame:
    inside = pricing.validity_window(F.lit(AS_OF), F.col("valid_from"), F.col("valid_to"))
    return w.cost_rates.withColumn("is_valid", inside)


@query
def kilo_band(w: Workspace) -> DataFrame:
    """Rate rows holding each of four weights, the band edges among them."""
    tests = {"at_5": 5.0, "at_9_99": 9.99, "at_20": 20.0, "at_45": 45.0}
    return w.cost_rates.select(
        "carrier", "zone", "kilo_min", "kilo_max",
        *[
            pricing.kilo_band(F.lit(kilo), F.col("kilo_min"), F.col("kilo_max")).alias(name)
            for name, kilo in tests.items()
        ],
    )


@query
def lookup_cost(w: Workspace) -> DataFrame:
    return pricing.lookup_cost(w.lines, w.book_for("cost"))


@query
def lookup_fuel(w: Workspace) -> DataFrame:
    return pricing.lookup_fuel(w.lines, w.book_for("fuel"))


@query
def lookup_zone_margin(w: Workspace) -> DataFrame:
    rows = w.classified.select("waybill", "seller_id", "zone")
    return pricing.lookup_zone_margin(rows, w.book_for("zone_margin"))


@query
def lookup_kilo_margin(w: Workspace) -> DataFrame:
    rows = w.classified.select("waybill", "seller_id", "kilos")
    return pricing.lookup_kilo_margin(rows, w.book_for("kilo_margin"))


@query
def lookup_flat(w: Workspace) -> DataFrame:
    rows = w.classified.select("waybill", "seller_id", "carrier", "zone", "kilos", "ship_date")
    return pricing.lookup_flat(rows, w.book_for("flat"))


@query
def price(w: Workspace) -> DataFrame:
    return w.priced.select("waybill", "method", "tariff_price")


@query
def tariff_preview(w: Workspace) -> DataFrame:
    return tariffs.listed_rates(w.preview_bands, w.cost_rates, AS_OF)


@query
def tariff_preview_flat(w: Workspace) -> DataFrame:
    return tariffs.tariff_preview_flat(w.credit_config, w.flat_rates)


@query
def tariff_matrix(w: Workspace) -> DataFrame:
    return tariffs.tariff_matrix(w.preview_bands, tariffs.ordered_zones(w.cost_rates))


@query
def zone_order(w: Workspace) -> DataFrame:
    zones = w.cost_rates.select("carrier", "zone").distinct()
    return zones.orderBy("carrier", *labels.zone_order(F.col("zone")))


@query
def band_label(w: Workspace) -> DataFrame:
    """Labels of every band, and of the one-kilo band at its start."""
    one_kilo = w.cost_rates.select("kilo_min", (F.col("kilo_min") + 1).alias("kilo_max"))
    bands = w.cost_rates.select("kilo_min", "kilo_max").union(one_kilo)
    return bands.withColumn("band", labels.band_label(F.col("kilo_min"), F.col("kilo_max")))


@query
def service_name(w: Workspace) -> DataFrame:
    name = labels.service_name(F.col("carrier"), F.col("service"))
    return w.cost_rates.select("carrier", "service", name.alias("service_name"))


@query
def fuel_today(w: Workspace) -> DataFrame:
    return tariffs.fuel_today(w.fuel_rates, AS_OF)


@query
def reprice(w: Workspace) -> DataFrame:
    """All stored price lists after the changes; only changed sellers are priced."""
    lists = tariffs.reprice(w.earlier_lists, w.wanted_lists, w.cost_rates, w.book, AS_OF)
    return tariffs.listed_rates(lists, w.cost_rates, AS_OF)


@query
def tariff_version(w: Workspace) -> DataFrame:
    return tariffs.tariff_version(w.tariff_versions, w.new_tariffs)


@query
def repriced_versions(w: Workspace) -> DataFrame:
    """Version rows of the price lists that a batch of configuration changes made."""
    lists = tariffs.generated_tariffs(w.preview_bands, w.wanted_lists, AS_OF, CLOSED_AT)
    return tariffs.tariff_version(w.tariff_versions, lists)


@query
def tariff_history(w: Workspace) -> DataFrame:
    return tariffs.tariff_history(w.tariff_versions)


# --- reports --------------------------------------------------------------------------------
@query
def summary_by_status(w: Workspace) -> DataFrame:
    return reports.summary_by_status(w.recon)


@query
def status_rollup(w: Workspace) -> DataFrame:
    return rollups.summary_by_status(w.rolled)


@query
def kpis_rollup(w: Workspace) -> DataFrame:
    return rollups.kpis(w.rolled)


@query
def months_rollup(w: Workspace) -> DataFrame:
    return rollups.close_months(w.rolled, w.periods)


@query
def clients_rollup(w: Workspace) -> DataFrame:
    """After three months were summed anew."""
    path = w.new_folder("rollup")
    rollups.write_rollup(w.recon, path)
    months = w.spark.createDataFrame([("1996-03",), (MONTH,), (None,)], "ship_month string")
    return rollups.by_client(rollups.refresh_rollup(path, w.recon, months, w.new_folder("staging")))


@query
def pipeline_summary(w: Workspace) -> DataFrame:
    """The chain in one: raw files, surcharges and mirror, reconciled, by status.

    Steps with large shuffles are written one by one, the first lines carrier by carrier.
    """
    book, lines = w.book, canonical_union(w)
    parts = [lines.filter(F.col("carrier") == carrier) for carrier in carriers.HEADER_MAPS]
    result = reconcile.reconcile(
        w._stored("first-lines", lambda path: reconcile.dedup_parts(parts, path)),
        w.scratch("mirror", mirror.latest_shipment(w.shipment_facts)), overweight_rollup(w),
        ingest_surcharges(w), w.credit_config, book,
    )
    return reports.summary_by_status(result)


@query
def kpis(w: Workspace) -> DataFrame:
    return reports.kpis(w.recon)


@query
def prepaid_clients(w: Workspace) -> DataFrame:
    return reports.prepaid_clients(w.recon, w.recharges)


@query
def credit_clients(w: Workspace) -> DataFrame:
    return reports.credit_clients(w.recon)


@query
def search_waybills(w: Workspace) -> DataFrame:
    return reports.search_waybills(
        w.recon, limit=100, offset=20, status="extra_due", client="customer", waybill="1"
    )


@query
def search_pages(w: Workspace) -> DataFrame:
    """The second page of a search by trigram postings: a hundred rows behind the twentieth match."""
    open_rows = reports.match_waybills(w.recon, status="extra_due")
    texts = {"client": "customer", "waybill": "001"}
    found = search.matching_rows(open_rows, **{c: (w.postings(c), t) for c, t in texts.items()})
    last = reports.waybill_page(found, 20).tail(1)
    return reports.waybill_page(found, 100, (last[0]["cost"], last[0]["waybill"]) if last else None)


@query
def search_total(w: Workspace) -> DataFrame:
    return reports.search_total(w.recon, status="extra_due", client="customer", waybill="1")


@query
def month_range_filter(w: Workspace) -> DataFrame:
    months = reports.month_range_filter(w.recon, "1996-03", "1999-10")
    return months.groupBy("ship_month").agg(F.count(F.lit(1)).alias("waybills"))


@query
def receivable(w: Workspace) -> DataFrame:
    return reports.receivable(w.recon)


@query
def close_months(w: Workspace) -> DataFrame:
    return reports.close_months(w.recon, w.periods)


@query
def close_detail(w: Workspace) -> DataFrame:
    return reports.close_detail(w.recon, MONTH)


@query
def close_month(w: Workspace) -> DataFrame:
    return reports.close_month(w.recon, w.periods, "1998-12", CLOSED_AT)


@query
def reopen_month(w: Workspace) -> DataFrame:
    reopened = w.status_changes.filter(F.col("month") > "1998-06").select("month")
    return reports.reopen_month(w.periods, reopened)


@query
def credit_config_overview(w: Workspace) -> DataFrame:
    return reports.credit_config_overview(w.recon, w.credit_config)


@query
def tariff_clients(w: Workspace) -> DataFrame:
    return reports.tariff_clients(w.recon, w.credit_config, w.flat_rates)


@query
def collections_worklist(w: Workspace) -> DataFrame:
    return reports.collections_worklist(w.recon)


@query
def by_client(w: Workspace) -> DataFrame:
    return reports.by_client(w.recon)


@query
def by_ship_month(w: Workspace) -> DataFrame:
    return reports.by_ship_month(w.recon)


@query
def actionable(w: Workspace) -> DataFrame:
    return reports.actionable(w.recon)


@query
def table_counts(w: Workspace) -> DataFrame:
    names = ("carrier_invoices", "shipments", "overweight", "surcharges", "charges")
    return tables.table_counts({name: w.table(name) for name in names})


@query
def services(w: Workspace) -> DataFrame:
    return tariffs.services(w.carrier_invoices, w.cost_rates)


@query
def list_cost_rates(w: Workspace) -> DataFrame:
    return tariffs.list_rows(w.cost_rates, ["carrier", "service", "zone", "kilo_min", "cost"])


@query
def list_flat_rates(w: Workspace) -> DataFrame:
    return tariffs.list_rows(w.flat_rates, ["seller_id", "carrier", "zone", "kilo_min", "price"])


@query
def list_fuel_rates(w: Workspace) -> DataFrame:
    return tariffs.list_rows(w.fuel_rates, ["carrier", "valid_from", "service", "pct"])


@query
def list_surcharge_map(w: Workspace) -> DataFrame:
    return tariffs.list_rows(w.surcharge_map, ["carrier", "concept"])


@query
def list_zone_margins(w: Workspace) -> DataFrame:
    return tariffs.list_rows(w.zone_margins, ["seller_id", "zone", "margin"])


@query
def list_kilo_margins(w: Workspace) -> DataFrame:
    return tariffs.list_rows(w.kilo_margins, ["seller_id", "kilo_min", "margin"])


@query
def list_client_carriers(w: Workspace) -> DataFrame:
    return tariffs.list_rows(w.client_carriers, ["seller_id", "carrier"])


# --- receivables ----------------------------------------------------------------------------
@query
def generate_charges(w: Workspace) -> DataFrame:
    return w.generated


@query
def merge_charges(w: Workspace) -> DataFrame:
    return receivables.merge_charges(w.charges, w.generated, CLOSED_AT)


@query
def upsert_charges(w: Workspace) -> DataFrame:
    """As `merge_charges` for one generated month, on a ledger stored by month."""
    path, month = w.new_folder("charges"), F.col("month") == MONTH
    tables.write_overwrite(w.charges, path, ["month"])
    merge = lambda old: receivables.merge_charges(old, w.generated.filter(month), CLOSED_AT, MONTH)
    touched = w.spark.createDataFrame([(MONTH,)], "month string")
    return tables.upsert_slices(
        w.spark, path, schemas.CHARGES, ["month"], touched, merge, w.new_folder("staging")
    )


@query
def charge_totals(w: Workspace) -> DataFrame:
    return receivables.charge_totals(w.charges)


@query
def list_charges(w: Workspace) -> DataFrame:
    return receivables.list_charges(w.charges, w.payments, w.attachments, AS_OF)


@query
def send_charges(w: Workspace) -> DataFrame:
    return receivables.send_charges(w.charges, w.sent_changes, w.credit_config, AS_OF)


@query
def recompute_charges(w: Workspace) -> DataFrame:
    return receivables.recompute_charges(w.charges, w.payments)


@query
def record_payments(w: Workspace) -> DataFrame:
    after, charges = receivables.record_payments(w.payments, w.new_payments, w.charges)
    return receivables.charge_balance(charges, after)


@query
def payment_history(w: Workspace) -> DataFrame:
    return receivables.payment_history(w.payments)


@query
def void_payments(w: Workspace) -> DataFrame:
    after, charges = receivables.void_payments(w.payments, w.voided_payments, w.charges)
    return receivables.charge_balance(charges, after)


@query
def override_status(w: Workspace) -> DataFrame:
    return receivables.override_status(w.charges, w.status_changes)


@query
def charge_detail(w: Workspace) -> DataFrame:
    return receivables.charge_detail(w.charges, w.recon, w.carrier_invoices)


@query
def client_statement(w: Workspace) -> DataFrame:
    return w.statement


@query
def statement_surcharges(w: Workspace) -> DataFrame:
    return w.surcharge_lines


@query
def statement_totals(w: Workspace) -> DataFrame:
    return receivables.statement_totals(w.charges, w.recon, w.surcharge_lines)


@query
def update_credit_config(w: Workspace) -> DataFrame:
    return w.config_after


@query
def config_changed(w: Workspace) -> DataFrame:
    return receivables.config_changed(w.credit_config, w.config_after)


@query
def set_attachment(w: Workspace) -> DataFrame:
    return receivables.set_attachment(w.attachments, w.new_attachments)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(build: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: present(build(Workspace(spark, folder)))

    return {name: bound(build) for name, build in QUERIES.items()}
