"""Headline timings: one JSON line on standard output.

Each query runs twice and the faster run counts, so that compiling code is not what is measured.
Results go to Spark's no-op sink: every row and column is computed, none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cargoledger.operators import pricing
from cargoledger.plans.catalog import QUERIES, Workspace, present
from cargoledger.sources import tables

HEADLINES = (
    "ingest_dhl", "ingest_paquete_express", "ingest_surcharges", "latest_shipment", "overweight_rollup",
    "dedup_invoices", "attribute", "price", "reconcile", "summary_by_status", "kpis",
    "prepaid_clients", "credit_clients", "receivable", "close_months", "close_detail",
    "collections_worklist", "by_client", "search_waybills", "generate_charges", "merge_charges",
    "list_charges", "recompute_charges", "client_statement", "statement_totals", "tariff_matrix",
)
RUNS = 2


def session(cpus: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cargoledger-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(build: Callable[[], DataFrame]) -> None:
    build().write.format("noop").mode("overwrite").save()


def timed(action: Callable[[], object]) -> float:
    seconds = []
    for _ in range(RUNS):
        start = time.perf_counter()
        action()
        seconds.append(time.perf_counter() - start)
    return round(min(seconds), 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(cpus)
    scratch = f"{tables.shared_folder(spark)}/{spark.sparkContext.applicationId}/bench"

    def store_book() -> None:
        w = Workspace(spark, folder)
        book = pricing.price_book(
            w.cost_rates, w.fuel_rates, w.zone_margins, w.kilo_margins, w.flat_rates
        )
        pricing.store_price_book(book, f"{scratch}/book")

    def store_result() -> None:
        tables.write_reconciliation(Workspace(spark, folder).reconciled, f"{scratch}/result")

    shared = Workspace(spark, folder)
    timings = {"price_book": timed(store_book)}
    _ = shared.book
    timings["write_reconciliation"] = timed(store_result)
    _ = shared.recon  # written once; the reports below read it
    for name in HEADLINES:
        build = QUERIES[name]
        timings[name] = timed(lambda: run(lambda: present(build(Workspace(spark, folder)))))
        print(f"{name}: {timings[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "freight_reconciliation_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
