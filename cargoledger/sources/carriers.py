"""Carrier invoice files: header-mapped normalisation to the canonical invoice line.

A raw frame is whatever ``spark.read`` yields for a carrier file. Columns are bound by header
name, a header that is absent gives NULL (or zero for amounts), and everything stays a
projection, so a load is one scan with pruned columns and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from operator import add
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoledger.functions import cleaners
from cargoledger.functions.money import AMOUNT
from cargoledger.schemas import CARRIER_INVOICES, CLIENT_INVOICES, check_schema, conform


@dataclass(frozen=True)
class HeaderMap:
    """Where each canonical column lives in a carrier's file."""

    carrier: str
    headers: dict[str, str]
    surcharge_headers: tuple[str, ...]
    date_formats: tuple[str, ...]
    has_currency: bool = True
    marks_returns: bool = True


# Header names of each carrier's invoice file.
DHL = HeaderMap(
    carrier="dhl",
    headers={
        "waybill": "No.De Guia", "account": "No.De Cuenta", "reference": "Referencia",
        "service": "Producto", "origin": "Org", "destination": "Des", "pieces": "Pza",
        "kilos": "Kilos", "ship_date": "Fecha Envio", "invoice_date": "Fecha Factura",
        "invoice_no": "No. Factura", "freight": "Flete", "insurance": "Seguro",
        "discount": "Descuento", "tax": "Imp.I.V.A.", "net_amount": "Importe Neto",
        "currency": "Moneda", "sender": "Remitente", "recipient": "Destinatario", "zone": "Zona",
    },
    surcharge_headers=("FF", "NX", "OO", "YB", "YE", "YK", "YY"),
    date_formats=cleaners.ISO_FORMATS,
)
FEDEX = HeaderMap(
    carrier="fedex",
    headers={
        "waybill": "Guia", "account": "Cuenta", "reference": "Referencia", "service": "Servicio",
        "origin": "Ciudad_Shipper", "destination": "Ciudad_Destino", "pieces": "Volumen",
        "kilos": "Peso_facturado", "ship_date": "Fecha_Envio", "invoice_date": "Fecha_Factura",
        "invoice_no": "Factura", "freight": "Flete", "discount": "Descuento",
        "tax": "MEXICO_IVA_FRT", "net_amount": "Total_Facturado", "currency": "Moneda",
        "sender": "Nombre_quien_Envia", "recipient": "Nombre_Destinatario", "zone": "Rate_Zona",
    },
    surcharge_headers=("Fuel_Surcharge",),
    date_formats=cleaners.ISO_FORMATS,
)
PAQUETE_EXPRESS = HeaderMap(
    carrier="paquete_express",
    headers={
        "waybill": "Rastreo", "account": "Guía", "reference": "Referencia",
        "service": "Tipo Servicio", "origin": "Plaza orig.", "destination": "Ciudad dest.",
        "pieces": "Cantidad", "kilos": "Peso", "ship_date": "Fecha envío",
        "invoice_date": "Fecha factura", "invoice_no": "Factura", "freight": "Flete",
        "insurance": "Seguro", "tax": "IVA", "net_amount": "Total",
        "sender": "Cliente origen", "recipient": "Cliente destino", "zone": "Tarifa",
    },
    surcharge_headers=("Otros", "RAD"),
    date_formats=cleaners.DAY_FIRST_FORMATS,
    has_currency=False,
    marks_returns=False,
)
HEADER_MAPS = {
    "dhl": DHL,
    "fedex": FEDEX,
    "paquete_express": PAQUETE_EXPRESS,
    "paquete_express_2": PAQUETE_EXPRESS,
}
DEFAULT_CURRENCY = "MXN"
TEXT_COLUMNS = (
    "waybill", "account", "reference", "service", "origin", "destination", "invoice_no",
    "currency", "sender", "recipient", "zone",
)
# Texts that find the shipment of a line or a return, and those that price and name it.
READ_TOGETHER = (("waybill", "reference"), ("service", "zone", "sender"))
AMOUNT_COLUMNS = ("freight", "insurance", "discount", "tax", "net_amount")
# Header aliases of client invoice files, first present wins.
CLIENT_KEY_HEADERS = ("No.De Guia", "guia")
CLIENT_TOTAL_HEADERS = ("Total neto", "Total")
CLIENT_NAME_HEADERS = ("Remitente", "Cliente")


def column_of(name: str) -> Column:
    return F.col(f"`{name}`")


def _trimmed_headers(raw: DataFrame) -> dict[str, T.StructField]:
    """Header text without outer blanks -> field; the last of two equal headers wins."""
    return {f.name.strip(): f for f in raw.schema if f.name and f.name.strip()}


def read_raw(spark: SparkSession, path: str, file_format: str = "csv", **options: str) -> DataFrame:
    """Raw carrier or client table; CSV cells stay text, so no inference pass is needed.

    One header holds for the whole load: files that differ in theirs go through ``read_invoices``.
    """
    if file_format == "csv":
        options = {"header": "true", "inferSchema": "false", **options}
    return with_source_file(spark.read.format(file_format).options(**options).load(path))


def file_headers(spark: SparkSession, path: str, encoding: str = "UTF-8") -> dict[str, list[str]]:
    """Header line -> files that start with it. One row per file comes to the driver.

    Only lines of a file's first block are looked at; the first of them is its header.
    """
    lines = spark.read.option("encoding", encoding).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    numbered = lines.where("block = 0").withColumn("line", F.monotonically_increasing_id())
    first = numbered.groupBy("file").agg(F.min_by("value", "line").alias("header"))
    found: dict[str, list[str]] = {}
    for row in first.orderBy("file").collect():
        found.setdefault(row["header"].rstrip("\r").lstrip("\ufeff"), []).append(unquote(row["file"]))
    return found


def read_raw_groups(spark: SparkSession, path: str, **options: str) -> list[DataFrame]:
    """CSV files of one load, one frame per header, so that every file is bound by its own."""
    options = {"header": "true", "inferSchema": "false", **options}
    return [
        with_source_file(spark.read.options(**options).csv(files))
        for files in file_headers(spark, path).values()
    ]


def read_invoices(
    spark: SparkSession, path: str, carrier: str, source_file: str | Column | None = None,
    **options: str,
) -> DataFrame:
    """All carrier files of a path as canonical lines, whatever the order and number of their columns."""
    groups = read_raw_groups(spark, path, **options)
    if not groups:
        raise ValueError(f"no file with a header under {path}")
    return canonical_union(normalise_invoices(raw, carrier, source_file) for raw in groups)


def with_source_file(df: DataFrame) -> DataFrame:
    """Tag every row with the base name of the file it came from."""
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def drop_blank_rows(raw: DataFrame, key_header: str) -> DataFrame:
    """Drop rows without a key; a wholly empty row has none either."""
    field = _trimmed_headers(raw).get(key_header)
    if field is None:
        raise ValueError(f"no column {key_header!r} among {raw.columns}")
    return raw.filter(cleaners.has_text(column_of(field.name), field.dataType))


def refused_rows(raw: DataFrame, carrier: str) -> DataFrame:
    """Rows with an amount beyond what the type holds, which `normalise_invoices` would end at: file, waybill and the row's
    amounts as read. Load the rest with ``raw`` less these (`without_refused`), and count these in the load log."""
    cells, rows = _amount_cells(raw, carrier), drop_blank_rows(raw, HEADER_MAPS[carrier].headers["waybill"])
    key = _trimmed_headers(raw)[HEADER_MAPS[carrier].headers["waybill"]]
    tag = F.col("source_file") if "source_file" in raw.columns else F.lit(None).cast("string")
    return rows.filter(cleaners.holds_too_large(cells, AMOUNT)).select(
        tag.alias("source_file"), cleaners.clean_text(column_of(key.name), key.dataType).alias("waybill"), cells.alias("amounts")
    )


def without_refused(raw: DataFrame, carrier: str) -> DataFrame:
    return raw.filter(~cleaners.holds_too_large(_amount_cells(raw, carrier), AMOUNT))


def _amount_cells(raw: DataFrame, carrier: str) -> Column:
    """Amount and surcharge cells of a row, as text."""
    spec, fields = HEADER_MAPS[carrier], _trimmed_headers(raw)
    names = [spec.headers[n] for n in AMOUNT_COLUMNS if n in spec.headers] + list(spec.surcharge_headers)
    found = [cleaners.as_text(column_of(fields[h].name), fields[h].dataType) for h in names if h in fields]
    return F.array(*found).cast("array<string>")


def normalise_invoices(
    raw: DataFrame, carrier: str, source_file: str | Column | None = None
) -> DataFrame:
    """Raw carrier table -> canonical 24-column invoice lines.

    Cells go through array transforms. Two dozen inlined cleaners would make a generated method too long for the JVM to
    compile, which is many times slower. Texts that are read together share an array, so groups of texts that nobody reads
    are not cleaned; all amounts share one, so that a line with an amount too large is an error whichever is read.
    """
    spec = HEADER_MAPS[carrier]
    fields = _trimmed_headers(raw)
    bound = {name: fields[h] for name, h in spec.headers.items() if h in fields}
    others = [n for n in TEXT_COLUMNS if not any(n in group for group in READ_TOGETHER)]
    texts = [[n for n in group if n in bound] for group in (*READ_TOGETHER, others)]
    amounts = [n for n in AMOUNT_COLUMNS if n in bound]
    extras = [fields[h] for h in spec.surcharge_headers if h in fields]

    def cell(field: T.StructField) -> Column:
        return cleaners.as_text(column_of(field.name), field.dataType)

    def cleaned(cells: list[Column], clean: Callable[[Column], Column], name: str) -> list[Column]:
        return [clean(F.array(*cells)).alias(name)] if cells else []

    def date(name: str) -> Column:
        field = bound.get(name)
        if field is None:
            return F.lit(None).cast("date")
        return cleaners.clean_date(column_of(field.name), field.dataType, spec.date_formats)

    number = lambda cells: cleaners.clean_amounts(cells, AMOUNT)
    pieces, kilos = bound.get("pieces"), bound.get("kilos")
    if source_file is None:
        origin = F.col("source_file") if "source_file" in raw.columns else F.lit(None)
    else:
        origin = source_file if isinstance(source_file, Column) else F.lit(source_file)
    parts = drop_blank_rows(raw, spec.headers["waybill"]).select(
        *[c for k, group in enumerate(texts) for c in cleaned([cell(bound[n]) for n in group], cleaners.clean_texts, f"texts_{k}")],
        *cleaned([cell(bound[n]) for n in amounts], number, "amounts"),
        *cleaned([cell(f) for f in extras], number, "extras"),
        (
            F.lit(None)
            if pieces is None
            else cleaners.clean_pieces(column_of(pieces.name), pieces.dataType)
        ).alias("pieces"),
        (
            F.lit(0.0)
            if kilos is None
            else cleaners.clean_number(column_of(kilos.name), "double", kilos.dataType)
        ).alias("kilos"),
        date("ship_date").alias("ship_date"),
        date("invoice_date").alias("invoice_date"),
        origin.alias("source_file"),
    )
    columns = {n: F.col(f"texts_{k}")[i] for k, group in enumerate(texts) for i, n in enumerate(group)}
    columns |= {n: F.col("amounts")[i] for i, n in enumerate(amounts)}
    columns |= {n: F.lit(None) for n in TEXT_COLUMNS if n not in bound}
    columns |= {n: F.lit(0) for n in AMOUNT_COLUMNS if n not in bound}
    columns["carrier"] = F.lit(carrier)
    columns["surcharges"] = reduce(
        add, [F.col("extras")[i] for i in range(len(extras))], F.lit(0).cast(AMOUNT)
    )
    columns["is_return"] = (
        cleaners.detect_return(columns["reference"]) if spec.marks_returns else F.lit(False)
    )
    if spec.has_currency:
        columns["currency"] = F.coalesce(columns["currency"], F.lit(DEFAULT_CURRENCY))
    else:
        columns["currency"] = F.lit(DEFAULT_CURRENCY)
    return parts.select(
        [columns.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in CARRIER_INVOICES]
    )


def canonical_union(frames: Iterable[DataFrame]) -> DataFrame:
    """All carriers in one table; every part must already have the canonical schema."""
    checked = [check_schema(frame, CARRIER_INVOICES) for frame in frames]
    return reduce(DataFrame.unionByName, checked)


def normalise_client_invoices(
    raw: DataFrame, source_file: str | Column | None = None
) -> DataFrame:
    """Client invoice table -> waybill, client, total; key and total columns must be there."""
    fields = _trimmed_headers(raw)

    def first(aliases: tuple[str, ...]) -> T.StructField | None:
        return next((fields[a] for a in aliases if a in fields), None)

    key, amount, name = (
        first(CLIENT_KEY_HEADERS), first(CLIENT_TOTAL_HEADERS), first(CLIENT_NAME_HEADERS)
    )
    if source_file is None:
        origin = F.col("source_file") if "source_file" in raw.columns else F.lit(None)
    else:
        origin = source_file if isinstance(source_file, Column) else F.lit(source_file)
    if key is None or amount is None:
        raise ValueError(f"no key or no total column among {raw.columns}")
    trimmed = lambda f: F.trim(cleaners.as_text(column_of(f.name), f.dataType))
    nothing = F.lit(None).cast("string")
    invoices = raw.select(
        trimmed(key).alias("waybill"),
        (F.nullif(trimmed(name), F.lit("")) if name is not None else nothing).alias("client"),
        cleaners.clean_number(column_of(amount.name), AMOUNT, amount.dataType).alias("total"),
        origin.alias("source_file"),
    )
    return conform(invoices.filter(F.col("waybill").isNotNull()), CLIENT_INVOICES)
