"""The given tables seen as freight-billing tables.

Each domain table is one SELECT in the dialect Spark SQL and DuckDB share, with ``{name}`` for
the tables it reads, so both engines start from the same rows. Only the mapping lives here; the
operators are DataFrame code, and the check SQL is written apart from them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from cargoledger import schemas
from cargoledger.schemas import conform

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

ORDER_KEY = "lpad(cast(l_orderkey as string), 10, '0')"
IS_RETURN = "(l_returnflag = 'R' and l_linenumber = 7)"
CARRIER = (
    "case {} % 4 when 0 then 'dhl' when 1 then 'fedex' when 2 then 'paquete_express' "
    "else 'paquete_express_2' end"
)
ORDER_MONTH = "substr(cast(cast(o_orderdate as date) as string), 1, 7)"
PRICE = "cast(l_extendedprice as decimal(18,2))"
LINE_CARRIER = CARRIER.format("l_suppkey")

DOMAIN: dict[str, str] = {}

DOMAIN["carrier_invoices"] = f"""
select {LINE_CARRIER} as carrier,
  case when {IS_RETURN} then '9' || lpad(cast(l_orderkey as string), 9, '0')
       else {ORDER_KEY} end as waybill,
  'A' || cast(l_suppkey % 10 as string) as account,
  case when {IS_RETURN} then 'RT' || {ORDER_KEY} else 'PO' || cast(l_partkey as string) end
    as reference,
  case when l_linestatus = 'O' then 'G' else 'N' end as service,
  'O' || cast(l_suppkey % 32 as string) as origin,
  'D' || cast(l_partkey % 32 as string) as destination,
  cast(l_linenumber as int) as pieces,
  l_quantity as kilos,
  case when l_discount > 0.095 then null else cast(l_shipdate as date) end as ship_date,
  case when l_tax < 0.005 then null else cast(l_shipdate as date) + 23 end as invoice_date,
  'F' || cast(l_suppkey as string) as invoice_no,
  cast({PRICE} as decimal(18,6)) as freight,
  cast(0 as decimal(18,6)) as insurance,
  cast(0 as decimal(18,6)) as discount,
  cast({PRICE} * cast(l_tax as decimal(4,2)) as decimal(18,6)) as surcharges,
  cast({PRICE} * cast(0.16 as decimal(4,2)) as decimal(18,6)) as tax,
  cast({PRICE} * 2 as decimal(18,6)) as net_amount,
  'MXN' as currency,
  'Sender ' || cast(l_suppkey as string) as sender,
  'Recipient ' || cast(l_partkey as string) as recipient,
  {IS_RETURN} as is_return,
  'lineitem.parquet' as source_file,
  cast(l_partkey % 8 as string) as zone
from {{lineitem}}"""

DOMAIN["shipments"] = """
select case when o_orderpriority = '5-LOW' and o_orderstatus = 'P'
         then 'M' || lpad(cast(o_orderkey as string), 9, '0')
         else lpad(cast(o_orderkey as string), 10, '0') end as waybill,
  o_custkey as seller_id,
  case c_custkey % 50 when 0 then 'SN00449' when 1 then 'se00724' when 2 then 'Inbursa ' || c_name
    else c_name end as seller_name,
  case when c_mktsegment in ('BUILDING', 'AUTOMOBILE') then 'Prepago'
       when c_mktsegment in ('MACHINERY', 'FURNITURE') then 'Prepago sin saldo'
       else '' end as payment_model,
  case when c_custkey % 50 = 0 then null
       else cast(cast(o_totalprice as decimal(18,2)) as decimal(18,6)) end as sale_price,
  o_orderdate as created_at
from {orders} join {customer} on o_custkey = c_custkey"""

# Warehouse facts keep superseded versions: an older row of some ids, with another carrier or amount.
DOMAIN["shipment_versions"] = f"""
select l_orderkey * 10 + l_linenumber as shipment_id,
  l_shipdate as version,
  {ORDER_KEY} as waybill,
  l_suppkey % 4 as carrier_no,
  case when l_discount < 0.005 then null else o_custkey + l_linenumber end as seller_id,
  case when l_discount < 0.015 then null else 'Seller ' || cast(l_suppkey as string) end
    as seller_name,
  case when l_returnflag = 'A' then 'Prepago' else 'Prepago sin saldo' end as payment_model,
  case when l_tax < 0.005 then null else cast({PRICE} as decimal(18,6)) end as sale_price,
  l_shipdate as created_at
from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey"""
_FACT = """select shipment_id, {version} as version, waybill,
  case {carrier} when 0 then 'DHL' when 1 then 'FEDEX' when 2 then 'PAQUETERIA EXPRESS'
    else 'OTHER' end as carrier_name,
  seller_id, seller_name, payment_model, {price} as sale_price, created_at
from {{shipment_versions}}"""
DOMAIN["shipment_facts"] = (
    _FACT.format(version="version", carrier="carrier_no", price="sale_price")
    + " union all "
    + _FACT.format(
        version="version - interval '3' day", carrier="(carrier_no + 1) % 4",
        price="cast(sale_price + 1000 as decimal(18,6))",
    )
    + " where shipment_id % 5 = 0"
)

DOMAIN["wallet_latest"] = """
select event_id as transaction_id, ts as version,
  case event_type when 'error' then 'Cargo por sobrepeso' else event_type end as transaction_type,
  case when value < 2 then '' when value < 4 then null
       else lpad(cast(cast(floor(event_id / 2) as bigint) as string), 10, '0') end as reference,
  cast(cast(value as decimal(18,2)) * 100 as decimal(18,6)) as amount,
  ts as created_at
from {events}"""
DOMAIN["wallet_transactions"] = """
select * from {wallet_latest}
union all
select transaction_id, version - interval '2' day as version, transaction_type, reference,
  cast(amount + 50 as decimal(18,6)) as amount, created_at
from {wallet_latest} where transaction_id % 3 = 0"""

DOMAIN["recharge_latest"] = """
select event_id as recharge_id, ts as version, user_id as seller_id,
  'Customer#' || lpad(cast(user_id as string), 9, '0') as seller_name,
  cast(cast(value as decimal(18,2)) as decimal(18,6)) as amount,
  ts as created_at
from {events} where event_type = 'purchase'"""
DOMAIN["recharge_facts"] = """
select * from {recharge_latest}
union all
select recharge_id, version - interval '1' day as version, seller_id, seller_name,
  cast(amount * 2 as decimal(18,6)) as amount, created_at
from {recharge_latest} where recharge_id % 4 = 0"""

DOMAIN["overweight"] = """
select reference as waybill, cast(amount as decimal(18,6)) as amount
from {wallet_latest}
where transaction_type = 'Cargo por sobrepeso' and reference <> ''"""

DOMAIN["recharges"] = """
select seller_id, min(seller_name) as seller_name, cast(sum(amount) as decimal(18,6)) as recharges
from {recharge_latest} group by seller_id"""

DOMAIN["surcharges"] = f"""
select {LINE_CARRIER} as carrier,
  {ORDER_KEY} as waybill,
  case when l_linestatus = 'O' then 'Extended area' else 'Oversize' end as concept,
  cast({PRICE} * cast(l_tax as decimal(4,2)) as decimal(18,6)) as amount
from {{lineitem}} where l_tax > 0.005"""

DOMAIN["credit_config"] = """
select c_custkey as seller_id, c_name as client,
  case c_custkey % 7 when 0 then 'automatic' when 1 then 'margin_global' when 2 then 'margin_zone'
    when 3 then 'margin_kilo' when 4 then 'flat' when 5 then 'manual' else null end as method,
  cast(c_custkey % 3 as decimal(18,6)) as value,
  'note ' || cast(c_custkey % 3 as string) as note,
  case when c_custkey % 6 = 0 then null
       else cast((10 + c_custkey % 10) / 100.0 as decimal(9,6)) end as margin,
  cast(case c_custkey % 5 when 0 then null when 1 then 0 when 2 then 15 when 3 then 30 else 45 end
       as int) as credit_days
from {customer} where c_mktsegment in ('MACHINERY', 'FURNITURE', 'AUTOMOBILE')"""

_BAND = "cast(floor(p_partkey / 32) as bigint) % 6"
_CARD = "cast(floor(p_partkey / 192) as bigint)"
DOMAIN["cost_rates"] = f"""
select {CARRIER.format("p_partkey")} as carrier,
  case cast(floor(p_partkey / 4) as bigint) % 8 when 7 then 'EXT'
    else cast(cast(floor(p_partkey / 4) as bigint) % 8 as string) end as zone,
  cast(case when {_CARD} % 5 = 4 then 8
    else case {_BAND} when 1 then 5 when 2 then 10 when 3 then 20 when 4 then 30 when 5 then 40
      else null end end as double) as kilo_min,
  cast(case when {_CARD} % 5 = 4 then 22
    else case {_BAND} when 0 then 5 when 1 then 10 when 2 then 20 when 3 then 30 when 4 then 40
      else null end end as double) as kilo_max,
  cast(cast(p_retailprice as decimal(18,2)) as decimal(18,6)) as cost,
  case {_CARD} % 4 when 1 then date '1997-01-01' when 2 then date '2000-01-01' else null end
    as valid_from,
  case {_CARD} % 4 when 1 then date '1999-12-31' when 3 then date '1996-12-31' else null end
    as valid_to,
  case (p_partkey + {_CARD}) % 3 when 0 then 'G' when 1 then null else '' end as service
from {{part}}"""

_YEAR = "cast(1995 + cast(floor(n_nationkey / 4) as int) as string)"
DOMAIN["fuel_rates"] = f"""
select {CARRIER.format("n_nationkey")} as carrier,
  cast({_YEAR} || '-01-01' as date) as valid_from,
  cast({_YEAR} || '-12-31' as date) as valid_to,
  cast((10 + n_nationkey) / 100.0 as decimal(9,6)) as pct,
  case when n_nationkey % 3 = 0 then 'G' else null end as service
from {{nation}}
union all
select distinct {CARRIER.format("n_nationkey")}, cast(null as date), cast(null as date),
  cast(0.12 as decimal(9,6)), cast(null as string)
from {{nation}}"""

DOMAIN["client_lanes"] = f"""
select distinct o_custkey as seller_id, {CARRIER.format("o_orderkey")} as carrier,
  cast(cast(floor(o_orderkey / 4) as bigint) % 8 as string) as zone,
  cast(cast(floor(o_orderkey / 4) as bigint) % 8 as int) as zone_no
from {{orders}}"""

_FLAT = """
select l.seller_id, client, carrier, zone, cast({low} as double) as kilo_min,
  cast({high} as double) as kilo_max,
  cast({base} + 10 * zone_no + l.seller_id % 100 as decimal(18,6)) as price,
  {since} as valid_from, {until} as valid_to
from {{client_lanes}} l join {{credit_config}} c on l.seller_id = c.seller_id
where method in ('flat', 'manual')"""
_NO_DATE = "cast(null as date)"
DOMAIN["flat_rates"] = " union all ".join(
    [
        _FLAT.format(low="null", high="25", base="500", since=_NO_DATE, until=_NO_DATE),
        _FLAT.format(low="25", high="null", base="700", since=_NO_DATE, until=_NO_DATE),
        _FLAT.format(
            low="10", high="30", base="600", since="date '1998-01-01'", until="date '1999-06-30'"
        ),
    ]
)

DOMAIN["zone_margins"] = """
select distinct seller_id, zone, cast((5 + zone_no) / 100.0 as decimal(9,6)) as margin
from {client_lanes}"""

_KILO = """
select c_custkey as seller_id, cast({low} as double) as kilo_min, cast({high} as double) as kilo_max,
  cast(({base} + c_custkey % 5) / 100.0 as decimal(9,6)) as margin
from {{customer}}"""
DOMAIN["kilo_margins"] = " union all ".join(
    _KILO.format(low=low, high=high, base=base)
    for low, high, base in (("null", "20", "8"), ("20", "45", "12"), ("15", "25", "20"))
)

# Which raw column of a carrier holds which surcharge; one is shared, one is in no file.
DOMAIN["surcharge_map"] = """
select carrier, concept, source_column from (values
  ('dhl', 'Extended area', 'FF'), ('dhl', 'Oversize', 'OO'), ('dhl', 'Handling', 'OO'),
  ('dhl', 'Absent', 'ZZ'), ('fedex', 'Fuel', 'Fuel_Surcharge'), ('fedex', 'Extended area', 'ODA'),
  ('paquete_express', 'Other', 'Otros'), ('paquete_express', 'Extended area', 'RAD'),
  ('paquete_express_2', 'Extended area', 'RAD')) as t(carrier, concept, source_column)"""

DOMAIN["client_carriers"] = "select distinct seller_id, carrier from {client_lanes}"

DOMAIN["periods"] = f"""
select {ORDER_MONTH} as month, 'closed' as status,
  cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(18,2)) as cost,
  cast(sum(cast(o_totalprice as decimal(18,2))) * 2 as decimal(18,2)) as income,
  cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(18,2)) as profit,
  cast('2002-01-01 08:00:00' as timestamp) as closed_at
from {{orders}} where o_orderdate < timestamp '1999-01-01 00:00:00'
group by {ORDER_MONTH}"""

DOMAIN["charges"] = f"""
select o_custkey as seller_id, 'Old client ' || cast(o_custkey as string) as client,
  {ORDER_MONTH} as month, count(*) as waybills,
  cast(cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(20,2)) * 0.5 as decimal(18,2)) as amount,
  case o_custkey % 6 when 0 then 'generated' when 1 then 'sent' when 2 then 'partial'
    when 3 then 'paid' when 4 then 'approved' else 'disputed' end as status,
  cast('2001-12-01 09:30:00' as timestamp) as generated_at,
  'first run' as note,
  case when o_custkey % 3 = 0 then 'prepaid' else 'credit' end as account_type,
  case when o_custkey % 3 = 0 then 'extra' else 'invoice' end as concept,
  cast(case when o_custkey % 6 = 2 then 100 else 0 end as decimal(18,2)) as paid_amount,
  case when o_custkey % 6 = 0 then null else date '1999-01-15' end as sent_date,
  case when o_custkey % 6 = 0 then null else date '1999-02-14' end as due_date
from {{orders}} group by o_custkey, {ORDER_MONTH}"""

_PAYMENT = """
select event_id as payment_id, user_id as seller_id,
  '1999-' || lpad(cast(1 + event_id % 12 as string), 2, '0') as month,
  cast(ts as date) as paid_on,
  cast(cast(value as decimal(18,2)) * 1000 as decimal(18,6)) as amount,
  event_type as note, ts as recorded_at
from {events} where event_type = """
DOMAIN["payments"] = _PAYMENT + "'click'"
DOMAIN["new_payments"] = _PAYMENT + "'purchase'"
DOMAIN["voided_payments"] = "select payment_id, seller_id, month from {payments} where amount > 60000"

DOMAIN["attachments"] = f"""
select o_custkey as seller_id, {ORDER_MONTH} as month,
  'invoice ' || cast(min(o_orderkey) as string) || '.pdf' as filename,
  'docs/' || cast(o_custkey as string) as path,
  cast('2001-12-15 10:00:00' as timestamp) as uploaded_at
from {{orders}} where o_orderstatus = 'F' group by o_custkey, {ORDER_MONTH}"""

DOMAIN["new_attachments"] = f"""
select o_custkey as seller_id, {ORDER_MONTH} as month,
  'upload ' || cast(o_orderkey as string) || '.pdf' as filename,
  'docs/new/' || cast(o_custkey as string) as path,
  o_orderdate as uploaded_at
from {{orders}} where o_orderstatus = 'P'"""

DOMAIN["sent_changes"] = f"""
select o_custkey as seller_id, {ORDER_MONTH} as month,
  case when o_custkey % 4 = 0 then null else cast(o_orderdate as date) + 40 end as sent_on
from {{orders}} where o_orderstatus = 'O'"""

DOMAIN["status_changes"] = f"""
select o_custkey as seller_id, {ORDER_MONTH} as month, 'approved' as status
from {{orders}} where o_orderpriority = '1-URGENT'"""

DOMAIN["config_changes"] = """
select c_custkey as seller_id,
  case when c_custkey % 4 = 0 then '' else 'Renamed ' || cast(c_custkey as string) end as client,
  case c_custkey % 8 when 0 then 'automatic' when 1 then 'margin_global' when 2 then 'margin_zone'
    when 3 then 'flat' when 4 then '' else null end as method,
  case when c_custkey % 9 = 0 then null
       else cast((12 + c_custkey % 6) / 100.0 as decimal(9,6)) end as margin,
  c_acctbal > 5000 as margin_sent,
  cast(60 as int) as credit_days,
  c_custkey % 2 = 0 as credit_days_sent
from {customer} where c_acctbal > 2000"""

DOMAIN["earlier_loads"] = """
select 'shipments' as table_name, n_name as carrier, '1995-01-01' as since,
  cast(n_nationkey as bigint) as row_count, cast('2001-11-01 00:00:00' as timestamp) as loaded_at
from {nation}"""

_VERSION = """
  {method} as method, cast(0.14 as decimal(9,6)) as margin, cast(0.16 as decimal(9,6)) as vat,
  date '1999-01-01' as valid_from, cast(null as date) as valid_to,"""
DOMAIN["tariff_versions"] = f"""
select o_custkey as seller_id, 'Client ' || cast(o_custkey as string) as client, 'dhl' as carrier,
  cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as version,
  {_VERSION.format(method="'margin_global'")}
  'tariffs/' || cast(o_custkey as string) || '/' || cast(o_orderkey as string) as path,
  'tariff ' || cast(o_orderkey as string) as filename,
  cast(o_orderkey % 1000 as bigint) as bytes, o_orderdate as created_at
from {{orders}} where o_orderstatus = 'F'"""

DOMAIN["new_tariffs"] = f"""
select c_custkey as seller_id, c_name as client, {CARRIER.format("n_nationkey")} as carrier,
  {_VERSION.format(method="'flat'")}
  'tariffs/' || cast(c_custkey as string) as path, 'tariff ' || c_name as filename,
  cast(c_custkey % 1000 as bigint) as bytes,
  cast('2001-12-20 12:00:00' as timestamp) as created_at
from {{customer}} join {{nation}} on c_nationkey = n_nationkey"""

# --- raw carrier files: carrier headers, text cells, blanks, bad numbers ---------------------
_CELL_KEY = (
    "case when l_tax < 0.005 and l_discount < 0.005 then '   ' "
    f"when l_tax < 0.005 and l_discount < 0.015 then null else '  ' || {ORDER_KEY} || ' ' end"
)
_CELL_REF = (
    f"case when {IS_RETURN} then case when l_linestatus = 'O' then 'rt' else 'RT' end || {ORDER_KEY} "
    "when l_linenumber = 6 then '' else ' PO   ' || cast(l_partkey as string) || '  x ' end"
)
_CELL_NET = (
    "case l_linenumber when 1 then 'n/a' when 2 then '' when 3 then cast(l_linenumber as string) || 'd' "
    f"else ' ' || cast({PRICE} as string) end"
)
_CELL_PRICE = f"cast({PRICE} as string)"
_CELL_TAX = f"cast(cast({PRICE} * cast(l_tax as decimal(4,2)) as decimal(18,4)) as string)"
_CELL_DISCOUNT = f"cast(cast({PRICE} * cast(l_discount as decimal(4,2)) as decimal(18,4)) as string)"
_CELL_PIECES = "case l_linenumber when 4 then 'two' when 5 then '3.7' else cast(l_linenumber as string) end"
_CELL_CURRENCY = "case when l_returnflag = 'A' then ' ' when l_returnflag = 'N' then 'USD' else null end"

DOMAIN["raw_dhl"] = f"""
select cast(cast(l_shipdate as date) + 23 as timestamp) as "Fecha Factura",
  {_CELL_KEY} as "No.De Guia", cast(l_suppkey as string) as "No.De Cuenta",
  {_CELL_REF} as "Referencia", case when l_linestatus = 'O' then 'G' else 'N ' end as "Producto",
  'O' || cast(l_suppkey % 32 as string) as "Org", 'D' || cast(l_partkey % 32 as string) as "Des",
  {_CELL_PIECES} as "Pza", cast(l_quantity as string) as "Kilos", l_shipdate as "Fecha Envio",
  'F' || cast(l_suppkey as string) as "No. Factura", {_CELL_PRICE} as "Flete", '0' as "Seguro",
  {_CELL_DISCOUNT} as "Descuento", {_CELL_TAX} as "Imp.I.V.A.", {_CELL_NET} as "Importe Neto",
  {_CELL_CURRENCY} as "Moneda", 'Sender  ' || cast(l_suppkey as string) as "Remitente",
  ' ' as "Destinatario", cast(l_partkey % 8 as string) as "Zona",
  {_CELL_TAX} as "FF", {_CELL_DISCOUNT} as "OO ", 'x' as "YB"
from {{lineitem}}"""

DOMAIN["raw_fedex"] = f"""
select {_CELL_KEY} as "Guia", {_CELL_NET} as "Total_Facturado",
  cast(l_suppkey as string) as "Cuenta", {_CELL_REF} as "Referencia",
  'Express  Saver' as "Servicio", 'City ' || cast(l_suppkey % 32 as string) as "Ciudad_Shipper",
  'City ' || cast(l_partkey % 32 as string) as "Ciudad_Destino", {_CELL_PIECES} as "Volumen",
  cast(l_quantity as string) as "Peso_facturado", l_shipdate as "Fecha_Envio",
  'F' || cast(l_suppkey as string) as "Factura", {_CELL_PRICE} as "Flete",
  {_CELL_DISCOUNT} as "Descuento", {_CELL_TAX} as "Fuel_Surcharge", '1.5' as "MEXICO_IVA_FRT",
  {_CELL_DISCOUNT} as "ODA", {_CELL_CURRENCY} as "Moneda",
  'Sender ' || cast(l_suppkey as string) as "Nombre_quien_Envia",
  'Recipient ' || cast(l_partkey as string) as "Nombre_Destinatario",
  'DL ' || cast(l_partkey % 8 as string) as "Rate_Zona"
from {{lineitem}}"""

_DAY_FIRST = (
    "cast(day(l_shipdate) as string) || '/' || cast(month(l_shipdate) as string) || '/' || "
    "cast(year(l_shipdate) as string)"
)
DOMAIN["raw_paquete_express"] = f"""
select {_CELL_KEY} as "Rastreo", 'G' || cast(l_orderkey as string) as "Guía",
  {_CELL_NET} as "Total", {_CELL_REF} as "Referencia", 'Standard' as "Tipo Servicio",
  'O' || cast(l_suppkey % 32 as string) as "Plaza orig.",
  'D' || cast(l_partkey % 32 as string) as "Ciudad dest.", {_CELL_PIECES} as "Cantidad",
  cast(l_quantity as string) as "Peso",
  ' ' || {_DAY_FIRST} || case l_linenumber when 1 then ' 10:15:30' when 2 then ' 9:05'
    when 3 then ' noon' else '' end as "Fecha envío",
  case when l_linenumber = 4 then cast(cast(l_shipdate as date) as string)
    else {_DAY_FIRST} end as "Fecha factura",
  'F' || cast(l_suppkey as string) as "Factura", {_CELL_PRICE} as "Flete", '2.25' as "Seguro",
  {_CELL_TAX} as "IVA", 'Sender ' || cast(l_suppkey as string) as "Cliente origen",
  'Recipient ' || cast(l_partkey as string) as "Cliente destino",
  'T' || cast(l_partkey % 8 as string) as "Tarifa", {_CELL_TAX} as "Otros",
  {_CELL_DISCOUNT} as "RAD"
from {{lineitem}}"""

DOMAIN["raw_client_invoices"] = """
select case when o_orderpriority = '5-LOW' then null
         else ' ' || lpad(cast(o_orderkey as string), 10, '0') end as "guia",
  case when o_orderstatus = 'P' then 'pending'
    else cast(cast(o_totalprice as decimal(18,2)) as string) end as "Total neto",
  case when o_orderstatus = 'O' then '' else ' Client ' || cast(o_custkey as string) end
    as "Cliente"
from {orders}"""

# Fixed value: bytes of a table file that one task reads at most. These files hold some eighty rows a kilobyte, so tasks that
# read Spark's default of 128 MB would sort ten million wide rows each before a shuffle, and spill them all.
SPLIT_BYTES = 16 << 20
SPLIT_SETTING = "spark.sql.files.maxPartitionBytes"

# Tables whose types the operators rely on.
TYPED = {
    "carrier_invoices": schemas.CARRIER_INVOICES, "shipments": schemas.SHIPMENTS,
    "overweight": schemas.OVERWEIGHT, "recharges": schemas.RECHARGES,
    "surcharges": schemas.SURCHARGES, "credit_config": schemas.CREDIT_CONFIG,
    "cost_rates": schemas.COST_RATES, "fuel_rates": schemas.FUEL_RATES,
    "flat_rates": schemas.FLAT_RATES, "zone_margins": schemas.ZONE_MARGINS,
    "kilo_margins": schemas.KILO_MARGINS, "surcharge_map": schemas.SURCHARGE_MAP,
    "client_carriers": schemas.CLIENT_CARRIERS, "periods": schemas.PERIODS,
    "charges": schemas.CHARGES, "payments": schemas.PAYMENTS, "new_payments": schemas.PAYMENTS,
    "attachments": schemas.CHARGE_ATTACHMENTS, "new_attachments": schemas.CHARGE_ATTACHMENTS,
    "earlier_loads": schemas.LOAD_LOG, "tariff_versions": schemas.TARIFF_VERSIONS,
}


def references(sql: str) -> list[str]:
    """Tables named in braces, in order of first use."""
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def _bytes(size: str) -> int:
    """Bytes of a size as Spark settings show it: a number and a unit of bytes, if any."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


class Domain:
    """Lazy domain tables over one folder of given tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._frames: dict[str, DataFrame] = {}
        if _bytes(spark.conf.get(SPLIT_SETTING)) > SPLIT_BYTES:  # a smaller split that someone chose stays
            spark.conf.set(SPLIT_SETTING, str(SPLIT_BYTES))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in DOMAIN and name not in GIVEN):
            raise AttributeError(name)
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._build(name)
        return self._frames[name]

    def scan(self, name: str) -> DataFrame:
        """A given table straight from its file."""
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _build(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.scan(name)
        sql = DOMAIN[name].replace('"', "`")
        df = self.spark.sql(sql, **{t: self.table(t) for t in references(sql)})
        return conform(df, TYPED[name]) if name in TYPED else df
