"""Check SQL for the registered queries, in DuckDB's dialect.

Written apart from the DataFrame code and in another shape: key unions instead of the full
outer join, ranked candidate joins instead of compiled rate cards. Only the domain mapping is
shared.
"""

from __future__ import annotations

from cargoledger.plans.domain import DOMAIN, GIVEN, references

STEPS: dict[str, str] = {}
CHECKS: dict[str, str] = {}

AS_OF = "date '1999-03-15'"
_TIE = "carrier, reference, service, kilos, zone, ship_date, sender, is_return"


def _first_line(more: str = "") -> str:
    extra = f", {more}" if more else ""
    return f"""select * from (
  select *, row_number() over (
    partition by waybill order by invoice_date, net_amount, {_TIE}{extra}) as line_no
  from {{carrier_invoices}}) where line_no = 1"""


STEPS["first_line"] = _first_line()
STEPS["first_line_detail"] = _first_line("destination")
STEPS["first_line_statement"] = _first_line("origin, destination, pieces, recipient")
STEPS["overweight_sum"] = (
    "select waybill, cast(sum(amount) as decimal(18,6)) as amount from {overweight} group by waybill"
)
STEPS["surcharge_sum"] = (
    "select waybill, cast(sum(amount) as decimal(18,6)) as amount from {surcharges} group by waybill"
)
STEPS["all_keys"] = "select waybill from {first_line} union select waybill from {shipments}"
STEPS["sides"] = """
select k.waybill, coalesce(l.carrier, 'dhl') as carrier, l.net_amount as cost,
  l.waybill is not null as has_cost, coalesce(l.is_return, false) as is_return,
  l.zone, l.kilos, l.service, coalesce(l.ship_date, cast(s.created_at as date)) as ship_date,
  l.invoice_date, l.sender,
  coalesce(s.seller_id, o.seller_id) as seller_id,
  coalesce(s.seller_name, o.seller_name) as seller_name,
  coalesce(s.payment_model, o.payment_model) as payment_model,
  case when l.is_return then 0 else s.sale_price end as sale_price,
  s.waybill is not null or o.waybill is not null as in_system,
  coalesce(w.amount, 0) as overweight, coalesce(g.amount, 0) as surcharge_cost
from {all_keys} k
left join {first_line} l on l.waybill = k.waybill
left join {shipments} s on s.waybill = k.waybill
left join {shipments} o
  on l.is_return and o.waybill = nullif(regexp_extract(l.reference, '[0-9]{10}'), '')
left join {overweight_sum} w on w.waybill = k.waybill
left join {surcharge_sum} g on g.waybill = k.waybill"""
_INTERNAL = "(regexp_matches(upper(seller_name), '^(SN00449|SE00724)$') or contains(upper(seller_name), 'INBURSA'))"
_METHOD = "coalesce(replace(method, 'manual', 'flat'), 'automatic')"
STEPS["house"] = f"select waybill from {{sides}} where in_system and {_INTERNAL}"
STEPS["models"] = """
select * from (values ('Prepago', 'prepaid'), ('Prepago sin saldo', 'credit')) as t(payment_model, kind)"""
STEPS["kinds"] = """
select waybill, 'not_in_system' as account_type from {sides} where not in_system
union all
select waybill, 'internal' from {house}
union all
select s.waybill, coalesce(m.kind, 'other')
from (select * from {sides} where in_system) s anti join {house} h on h.waybill = s.waybill
left join {models} m on m.payment_model = s.payment_model"""
STEPS["billing"] = f"select seller_id, {_METHOD} as billing_method, margin from {{credit_config}}"
STEPS["accounts"] = """
select s.*, n.account_type, coalesce(c.billing_method, 'automatic') as billing_method,
  c.margin as client_margin,
  cast(1 + coalesce(case when h.waybill is null then c.margin end, 0.14) as decimal(10,6)) as factor
from {sides} s join {kinds} n on n.waybill = s.waybill left join {house} h on h.waybill = s.waybill
left join {billing} c on c.seller_id = s.seller_id"""

_VALID = (
    "({day} is not null and (r.valid_from is null or r.valid_from <= {day}) "
    "and (r.valid_to is null or {day} <= r.valid_to))"
)
_BAND = (
    "({kilo} is not null and (r.kilo_min is null or r.kilo_min <= {kilo}) "
    "and (r.kilo_max is null or {kilo} < r.kilo_max))"
)
_SERVICE = "(nullif(r.service, '') is null or r.service = b.service)"
_EXACT = "(nullif(r.service, '') is not distinct from nullif(b.service, ''))"


def _best_cost(rows: str, key: str, kilo: str, day: str) -> str:
    return f"""select {key}, r.cost as unit_cost from {{{rows}}} b join {{cost_rates}} r
  on r.carrier = b.carrier and r.zone = b.zone and {_BAND.format(kilo=kilo)}
  and {_VALID.format(day=day)} and {_SERVICE}
qualify row_number() over (partition by {key} order by {_EXACT} desc, r.kilo_min, r.cost) = 1"""


def _best_fuel(rows: str, key: str, day: str) -> str:
    return f"""select {key}, r.pct as fuel from {{{rows}}} b join {{fuel_rates}} r
  on r.carrier = b.carrier and {_VALID.format(day=day)} and {_SERVICE}
qualify row_number() over (
  partition by {key} order by {_EXACT} desc, r.valid_from desc nulls last, r.pct) = 1"""


def _best_kilo(rows: str, key: str, kilo: str) -> str:
    return f"""select {key}, r.margin from {{{rows}}} b join {{kilo_margins}} r
  on r.seller_id = b.seller_id and {_BAND.format(kilo=kilo)}
qualify row_number() over (partition by {key} order by r.kilo_min, r.margin) = 1"""


STEPS["cost_pick"] = _best_cost("first_line", "b.waybill", "b.kilos", "b.ship_date")
STEPS["fuel_pick"] = _best_fuel("first_line", "b.waybill", "b.ship_date")
STEPS["account_cost"] = _best_cost("accounts", "b.waybill", "b.kilos", "b.ship_date")
STEPS["account_fuel"] = _best_fuel("accounts", "b.waybill", "b.ship_date")
STEPS["account_kilo"] = _best_kilo("accounts", "b.waybill", "b.kilos")
STEPS["zone_unique"] = (
    "select seller_id, zone, min(margin) as margin from {zone_margins} group by seller_id, zone"
)
STEPS["account_flat"] = f"""
select b.waybill, r.price from {{accounts}} b join {{flat_rates}} r
  on r.seller_id = b.seller_id and r.carrier = b.carrier and r.zone = b.zone
  and {_BAND.format(kilo='b.kilos')} and {_VALID.format(day='b.ship_date')}
qualify row_number() over (partition by b.waybill order by r.kilo_min, r.price) = 1"""


def _price_of(method: str, global_margin: str) -> str:
    margin = (
        f"case {method} when 'margin_global' then coalesce({global_margin}, 0) "
        "when 'margin_zone' then coalesce(z.margin, 0) else coalesce(k.margin, 0) end"
    )
    return f"""case when {method} = 'flat' then cast(cast(f.price as decimal(24,6)) * 1.16 as decimal(30,10))
    when {method} like 'margin%' then cast(c.unit_cost
      * (cast(1 + coalesce(u.fuel, 0) as decimal(20,6)) * cast(1 + {margin} as decimal(20,6)) * 1.16)
      as decimal(30,10)) end"""


STEPS["tariffed"] = f"""
select a.*, {_price_of('a.billing_method', 'a.client_margin')} as tariff_price
from {{accounts}} a
left join {{account_cost}} c on c.waybill = a.waybill
left join {{account_fuel}} u on u.waybill = a.waybill
left join {{zone_unique}} z on z.seller_id = a.seller_id and z.zone = a.zone
left join {{account_kilo}} k on k.waybill = a.waybill
left join {{account_flat}} f on f.waybill = a.waybill"""
STEPS["billed"] = """
select *, account_type = 'credit' and billing_method <> 'automatic' as by_tariff,
  cast(coalesce(sale_price, 0) + overweight as decimal(30,10)) as already_billed,
  cast(cast(cost as decimal(24,6)) * factor as decimal(30,10)) as floor_price
from {tariffed}"""
STEPS["amounts"] = """
select *, cast(0 as decimal(30,10)) as surcharge_price from {billed} where not by_tariff
union all
select *, cast(surcharge_cost * cast(1 + coalesce(client_margin, 0) as decimal(20,6)) * 1.16
  as decimal(30,10)) from {billed} where by_tariff"""
STEPS["incomes"] = """
select waybill, already_billed as income_raw from {amounts} where not has_cost
union all
select waybill, floor_price from {amounts} where has_cost and account_type = 'internal'
union all
select waybill, tariff_price + surcharge_price from {amounts} where has_cost and by_tariff
union all
select waybill, greatest(already_billed, floor_price) from {amounts}
where has_cost and not by_tariff and account_type in ('credit', 'prepaid', 'other')"""
STEPS["extras"] = """
select waybill, floor_price - already_billed as extra_raw from {amounts}
where has_cost and not by_tariff and floor_price > already_billed"""
STEPS["valued"] = """
select a.*, cast(coalesce(e.extra_raw, 0) as decimal(30,10)) as extra_raw,
  cast(i.income_raw as decimal(30,10)) as income_raw
from {amounts} a left join {extras} e on e.waybill = a.waybill
left join {incomes} i on i.waybill = a.waybill"""
# every label that fits a waybill, and its rank; the first one counts
STEPS["fitting"] = """
select waybill, 6 as place, 'billed_ok' as status from {valued}
union all select waybill, 5, 'extra_due' from {valued} where extra_raw > 0.5
union all select waybill, 4, 'credit_unbilled' from {valued} where by_tariff and tariff_price is null
union all select waybill, 3, 'internal' from {valued} where account_type = 'internal'
union all select waybill, 2, 'billed_cost_pending' from {valued} where not has_cost
union all select waybill, 1, 'not_in_system' from {valued} where not in_system"""
STEPS["labels"] = "select waybill, min_by(status, place) as status from {fitting} group by waybill"
STEPS["recon"] = """
select v.waybill, l.status, is_return, has_cost, carrier, coalesce(seller_name, sender) as client,
  seller_id, account_type, payment_model, billing_method as method, tariff_price,
  strftime(invoice_date, '%Y-%m') as invoice_month, strftime(ship_date, '%Y-%m') as ship_month,
  cast(sale_price as decimal(18,6)) as sale_price, cast(cost as decimal(18,2)) as cost,
  cast(income_raw as decimal(18,2)) as income, cast(income_raw - cost as decimal(18,2)) as margin,
  cast(extra_raw as decimal(18,2)) as extra, cast(surcharge_price as decimal(18,2)) as surcharges,
  cast(overweight as decimal(18,2)) as overweight_billed
from {valued} v join {labels} l on l.waybill = v.waybill"""


#: Steps worked out by themselves, so that no plan joins rate rows into the middle of them.
ONCE = ("accounts", "preview_keys", "shipments_now")


def statement(body: str) -> str:
    """One statement: the body with the tables and steps it needs as a WITH chain."""
    known = {**DOMAIN, **STEPS}
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in references(sql):
            if name in known and name not in ordered:
                visit(known[name])
                ordered.append(name)

    visit(body)

    def plain(sql: str) -> str:
        for name in (*known, *GIVEN):
            sql = sql.replace("{" + name + "}", name)
        return sql

    how = {name: "materialized " if name in ONCE else "" for name in ordered}
    chain = ",\n".join(f"{name} as {how[name]}({plain(known[name])})" for name in ordered)
    return (f"with {chain}\n" if chain else "") + plain(body)


_CASTS = {
    "n": "cast({0} as double)",
    "d": "cast({0} as varchar)",
    "t": "strftime({0}, '%Y-%m-%d %H:%M:%S')",
}


def check(name: str, columns: str, body: str) -> None:
    """Register a check. ``columns`` lists the output; ``:n`` marks an exact number, ``:d`` a
    day and ``:t`` a time, which are shown as the registered query shows them."""
    shown = []
    for column in columns.split():
        label, _, kind = column.partition(":")
        shown.append(f"{_CASTS[kind].format(label) if kind else label} as {label}")
    CHECKS[name] = statement(f"select {', '.join(shown)} from ({body}) as result")


# --- sources --------------------------------------------------------------------------------
CANONICAL = (
    "carrier waybill account reference service origin destination pieces kilos ship_date:d "
    "invoice_date:d invoice_no freight:n insurance:n discount:n surcharges:n tax:n net_amount:n "
    "currency sender recipient is_return source_file zone"
)
_NUMBER = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def _text(cell: str) -> str:
    return rf"nullif(trim(regexp_replace({cell}, '\s+', ' ', 'g')), '')"


def _number_or_null(cell: str, target: str) -> str:
    return (
        f"case when regexp_matches(trim({cell}), {_NUMBER}) then try_cast(trim({cell}) as {target}) end"
    )


def _number(cell: str, target: str = "decimal(18,6)") -> str:
    return f"coalesce({_number_or_null(cell, target)}, 0)"


def _day(cell: str) -> str:
    return (
        f"cast(try_strptime(trim({cell}), "
        "['%d/%m/%Y %H:%M:%S', '%d/%m/%Y %H:%M', '%d/%m/%Y']) as date)"
    )


def _pieces(cell: str) -> str:
    return f"cast(trunc({_number_or_null(cell, 'double')}) as int)"


_RETURN = "regexp_matches(upper(coalesce({0}, '')), '^RT[0-9]{{10}}$')"

_DHL_LINES = f"""
select 'dhl' as carrier, {_text('"No.De Guia"')} as waybill, {_text('"No.De Cuenta"')} as account,
  {_text('"Referencia"')} as reference, {_text('"Producto"')} as service, {_text('"Org"')} as origin,
  {_text('"Des"')} as destination, {_pieces('"Pza"')} as pieces, {_number('"Kilos"', 'double')} as kilos,
  cast("Fecha Envio" as date) as ship_date, cast("Fecha Factura" as date) as invoice_date,
  {_text('"No. Factura"')} as invoice_no, {_number('"Flete"')} as freight,
  {_number('"Seguro"')} as insurance, {_number('"Descuento"')} as discount,
  {_number('"FF"')} + {_number('"OO "')} as surcharges, {_number('"Imp.I.V.A."')} as tax,
  {_number('"Importe Neto"')} as net_amount, coalesce({_text('"Moneda"')}, 'MXN') as currency,
  {_text('"Remitente"')} as sender, {_text('"Destinatario"')} as recipient,
  {_RETURN.format(_text('"Referencia"'))} as is_return, 'dhl.csv' as source_file,
  {_text('"Zona"')} as zone
from {{raw_dhl}} where {_text('"No.De Guia"')} is not null"""
_FEDEX_LINES = f"""
select 'fedex' as carrier, {_text('"Guia"')} as waybill, {_text('"Cuenta"')} as account,
  {_text('"Referencia"')} as reference, {_text('"Servicio"')} as service,
  {_text('"Ciudad_Shipper"')} as origin, {_text('"Ciudad_Destino"')} as destination,
  {_pieces('"Volumen"')} as pieces, {_number('"Peso_facturado"', 'double')} as kilos,
  cast("Fecha_Envio" as date) as ship_date, cast(null as date) as invoice_date,
  {_text('"Factura"')} as invoice_no, {_number('"Flete"')} as freight, 0 as insurance,
  {_number('"Descuento"')} as discount, {_number('"Fuel_Surcharge"')} as surcharges,
  {_number('"MEXICO_IVA_FRT"')} as tax, {_number('"Total_Facturado"')} as net_amount,
  coalesce({_text('"Moneda"')}, 'MXN') as currency, {_text('"Nombre_quien_Envia"')} as sender,
  {_text('"Nombre_Destinatario"')} as recipient,
  {_RETURN.format(_text('"Referencia"'))} as is_return, 'fedex.csv' as source_file,
  {_text('"Rate_Zona"')} as zone
from {{raw_fedex}} where {_text('"Guia"')} is not null"""


def _px_lines(carrier: str, source_file: str) -> str:
    return f"""
select '{carrier}' as carrier, {_text('"Rastreo"')} as waybill, {_text('"Guía"')} as account,
  {_text('"Referencia"')} as reference, {_text('"Tipo Servicio"')} as service,
  {_text('"Plaza orig."')} as origin, {_text('"Ciudad dest."')} as destination,
  {_pieces('"Cantidad"')} as pieces, {_number('"Peso"', 'double')} as kilos,
  {_day('"Fecha envío"')} as ship_date, {_day('"Fecha factura"')} as invoice_date,
  {_text('"Factura"')} as invoice_no, {_number('"Flete"')} as freight,
  {_number('"Seguro"')} as insurance, 0 as discount,
  {_number('"Otros"')} + {_number('"RAD"')} as surcharges, {_number('"IVA"')} as tax,
  {_number('"Total"')} as net_amount, 'MXN' as currency, {_text('"Cliente origen"')} as sender,
  {_text('"Cliente destino"')} as recipient, false as is_return, '{source_file}' as source_file,
  {_text('"Tarifa"')} as zone
from {{raw_paquete_express}} where {_text('"Rastreo"')} is not null"""


_PX_ONE = _px_lines("paquete_express", "px.csv")
_PX_TWO = _px_lines("paquete_express_2", "px2.csv")
check("ingest_dhl", CANONICAL, _DHL_LINES)
check("ingest_fedex", CANONICAL, _FEDEX_LINES)
check("ingest_paquete_express", CANONICAL, _PX_ONE)
check("ingest_second_account", CANONICAL, _PX_TWO)
_ALL_LINES = " union all ".join(
    "select " + ", ".join(
        f"cast({c.split(':')[0]} as decimal(18,6)) as {c.split(':')[0]}" if c.endswith(":n")
        else c.split(":")[0] for c in CANONICAL.split()
    ) + f" from ({part})"
    for part in (_DHL_LINES, _FEDEX_LINES, _PX_ONE, _PX_TWO)
)
check("canonical_union", CANONICAL, _ALL_LINES)
check(
    "ingest_client_invoices", "waybill client total:n source_file",
    f"""select trim("guia") as waybill, nullif(trim("Cliente"), '') as client,
      {_number('"Total neto"')} as total, 'clients.csv' as source_file
    from {{raw_client_invoices}} where "guia" is not null""",
)
_SURCHARGE_CELLS = {
    ("dhl", "raw_dhl", "No.De Guia"): (("Extended area", "FF"), ("Oversize", "OO "), ("Handling", "OO ")),
    ("fedex", "raw_fedex", "Guia"): (("Fuel", "Fuel_Surcharge"), ("Extended area", "ODA")),
    ("paquete_express", "raw_paquete_express", "Rastreo"): (("Other", "Otros"), ("Extended area", "RAD")),
    ("paquete_express_2", "raw_paquete_express", "Rastreo"): (("Extended area", "RAD"),),
}
_ALL_SURCHARGES = " union all ".join(
    f"""select '{carrier}' as carrier, trim("{key}") as waybill, '{concept}' as concept,
      {_number(f'"{column}"')} as amount
    from {{{table}}} where trim("{key}") <> '' and {_number(f'"{column}"')} <> 0"""
    for (carrier, table, key), cells in _SURCHARGE_CELLS.items()
    for concept, column in cells
)
check("ingest_surcharges", "carrier waybill concept amount:n", _ALL_SURCHARGES)
check(
    "ingest_header_variants", CANONICAL,
    f"""select * replace (
      case when regexp_matches(invoice_no, '[17]$') then 0 else insurance end as insurance,
      case when regexp_matches(invoice_no, '[17]$') then null else zone end as zone)
    from ({_DHL_LINES})""",
)
check(
    "clean_text", "waybill reference sender recipient",
    f"""select {_text('"No.De Guia"')} as waybill, {_text('"Referencia"')} as reference,
      {_text('"Remitente"')} as sender, {_text('"Destinatario"')} as recipient from {{raw_dhl}}""",
)
check(
    "clean_number", "net_amount:n kilos surcharge:n",
    f"""select {_number('"Importe Neto"')} as net_amount, {_number('"Kilos"', 'double')} as kilos,
      {_number('"YB"')} as surcharge from {{raw_dhl}}""",
)
check(
    "clean_number_or_null", "net_amount:n pieces",
    f"""select {_number_or_null('"Importe Neto"', 'decimal(18,6)')} as net_amount,
      case when regexp_matches("Pza", '^[0-9]+$') then try_cast("Pza" as int) end as pieces
    from {{raw_dhl}}""",
)
check(
    "clean_date", "ship_date:d invoice_date:d",
    f"""select {_day('"Fecha envío"')} as ship_date, {_day('"Fecha factura"')} as invoice_date
    from {{raw_paquete_express}}""",
)
check(
    "clean_pieces", "cell pieces",
    f"""select "Pza" as cell, {_pieces('"Pza"')} as pieces from {{raw_dhl}}""",
)
check(
    "drop_blank_rows", "cell account",
    """select "Guia" as cell, "Cuenta" as account from {raw_fedex} where trim("Guia") <> ''""",
)
check(
    "detect_return", "reference is_return",
    f"""select reference, {_RETURN.format('reference')} as is_return
    from (select {_text('"Referencia"')} as reference from {{raw_dhl}})""",
)
check(
    "source_file_tag", "l_orderkey l_linenumber source_file",
    "select l_orderkey, l_linenumber, 'lineitem.parquet' as source_file from {lineitem}",
)


def _current(table: str, key: str, *ties: str) -> str:
    """The latest version of each id; of rows that share it, the first by the tie columns, falling."""
    order = ", ".join(f"{c} desc nulls last" for c in ("version", *ties))
    return f"""select * from {{{table}}}
    qualify row_number() over (partition by {key} order by {order}) = 1"""


STEPS["shipments_now"] = _current(
    "shipment_facts", "shipment_id", "sale_price", "carrier_name", "seller_id", "seller_name", "payment_model",
    "waybill", "created_at",
)
STEPS["wallet_now"] = _current(
    "wallet_transactions", "transaction_id", "amount", "reference", "transaction_type"
)
STEPS["recharges_now"] = _current(
    "recharge_facts", "recharge_id", "amount", "seller_id", "seller_name", "created_at"
)


def _latest(column: str, where: str) -> str:
    return f"""(select waybill, {column} from {{shipments_now}}
  where {column} is not null and {where}
  qualify row_number() over (partition by waybill order by created_at desc, {column} desc) = 1)"""


def _latest_shipments(where: str) -> str:
    return f"""
select k.waybill, a.seller_id, b.seller_name, c.payment_model, d.sale_price, k.created_at
from (select waybill, max(created_at) as created_at from {{shipments_now}}
      where {where} group by waybill) k
left join {_latest('seller_id', where)} a on a.waybill = k.waybill
left join {_latest('seller_name', where)} b on b.waybill = k.waybill
left join {_latest('payment_model', where)} c on c.waybill = k.waybill
left join {_latest('sale_price', where)} d on d.waybill = k.waybill"""


SHIPMENT = "waybill seller_id seller_name payment_model sale_price:n created_at:t"
check(
    "latest_shipment", SHIPMENT,
    _latest_shipments(
        "carrier_name in ('DHL', 'FEDEX', 'PAQUETERIA EXPRESS') "
        "and created_at >= timestamp '1995-01-01 00:00:00'"
    ),
)
check(
    "dedup_by_id",
    "shipment_id version:t waybill sale_price:n carrier_name seller_id seller_name payment_model",
    "select * from {shipments_now}",
)
_OVERWEIGHT = """select reference as waybill, round(sum(amount), 2) as amount from {wallet_now}
    where transaction_type = 'Cargo por sobrepeso' and reference is not null and reference <> ''
    group by reference"""
check("overweight_rollup", "waybill amount:n", _OVERWEIGHT)
check(
    "recharge_rollup", "seller_id seller_name recharges:n",
    """select seller_id, any_value(seller_name) as seller_name, round(sum(amount), 2) as recharges
    from {recharges_now} where created_at >= timestamp '2024-01-01' group by seller_id""",
)
PAYMENT = "payment_id seller_id month paid_on:d amount:n note recorded_at:t"
check(
    "append_batch", PAYMENT, "select * from {payments} union all select * from {new_payments}"
)
check(
    "replace_slice", "carrier waybill concept amount:n",
    """select carrier, waybill, concept, amount from {surcharges} where carrier not in ('dhl', 'fedex')
    union all
    select carrier, waybill, 'Reloaded', surcharges from {carrier_invoices}
    where carrier in ('dhl', 'fedex')""",
)
check("replace_all", SHIPMENT, _latest_shipments("true"))
check("merge_shipments", SHIPMENT, _latest_shipments("true"))
check(
    "load_log", "table_name carrier since row_count loaded_at:t",
    """select * from {earlier_loads}
    union all
    select 'shipments', 'multi', '1995-01-01', count(*), timestamp '2002-02-01 08:00:00'
    from {shipments}""",
)
check(
    "replace_stored_slice", "carrier waybill concept amount:n",
    """select carrier, waybill, concept, amount from {surcharges}
    where carrier not in ('dhl', 'fedex', 'paquete_express')
    union all
    select carrier, waybill, 'Reloaded', surcharges from {carrier_invoices}
    where carrier in ('dhl', 'fedex')""",
)
check(
    "evolve_schema", "seller_id client method value:n note margin:n credit_days",
    """select seller_id, client, method, value, note, cast(null as decimal(9,6)) as margin,
      cast(null as int) as credit_days from {credit_config}""",
)
RECON = (
    "waybill carrier client seller_id payment_model account_type method is_return has_cost cost:n "
    "sale_price:n overweight_billed:n tariff_price:n extra:n surcharges:n income:n margin:n status "
    "ship_month invoice_month"
)


def _chained(prefix: str, target: str, sources: dict[str, str]) -> None:
    """The steps that lead to a target once more, under a prefix, on other source tables."""
    needed: dict[str, None] = {}

    def visit(name: str) -> None:
        for part in references(STEPS[name]):
            if part in STEPS and part not in needed:
                visit(part)
        needed[name] = None

    visit(target)
    renamed = {name: prefix + name for name in (*needed, *sources)}
    for name, sql in sources.items():
        STEPS[prefix + name] = sql
    for name in needed:
        sql = STEPS[name]
        for old, new in renamed.items():
            sql = sql.replace("{" + old + "}", "{" + new + "}")
        STEPS[prefix + name] = sql


_chained(
    "raw_", "recon",
    {
        "carrier_invoices": _ALL_LINES, "surcharges": _ALL_SURCHARGES, "overweight": _OVERWEIGHT,
        "shipments": _latest_shipments("true"),
    },
)
check("write_reconciliation", RECON, "select * from {recon}")

# --- reconciliation -------------------------------------------------------------------------
check(
    "dedup_invoices",
    "waybill invoice_date:d net_amount:n carrier reference service kilos zone ship_date:d sender "
    "is_return",
    "select * from {first_line}",
)
check(
    "return_origin", "waybill reference origin",
    """select waybill, reference,
      case when is_return then nullif(regexp_extract(reference, '[0-9]{10}'), '') end as origin
    from {carrier_invoices}""",
)
check(
    "overweight_by_waybill", "waybill overweight:n",
    "select waybill, amount as overweight from {overweight_sum}",
)
check(
    "surcharge_by_waybill", "waybill surcharge_cost:n",
    "select waybill, amount as surcharge_cost from {surcharge_sum}",
)
check(
    "attribute",
    "waybill carrier cost:n has_cost is_return zone kilos service ship_date:d invoice_date:d sender "
    "seller_id seller_name payment_model sale_price:n in_system overweight:n surcharge_cost:n",
    "select * from {sides}",
)
check(
    "internal_match", "waybill seller_name is_internal",
    f"select waybill, seller_name, {_INTERNAL} as is_internal from {{shipments}}",
)
check(
    "internal_factor", "waybill factor:n",
    f"select waybill, case when {_INTERNAL} then 1.14 else 1 end as factor from {{shipments}}",
)
check(
    "normalise_method", "seller_id method",
    f"select seller_id, {_METHOD} as method from {{credit_config}}",
)
check(
    "classify_account", "waybill seller_id account_type method",
    "select waybill, seller_id, account_type, billing_method as method from {accounts}",
)
check("charge_factor", "waybill client_margin:n factor:n", "select * from {accounts}")
check("already_billed", "waybill already_billed:n", "select * from {amounts}")
check("surcharge_price", "waybill surcharge_price:n", "select * from {amounts}")
check("extra_due", "waybill extra_raw:n", "select * from {valued}")
check("accrued_income", "waybill income_raw:n", "select * from {valued}")
check("margin", "waybill margin:n", "select * from {recon}")
check("label_status", "waybill status", "select * from {recon}")
check("accounting_months", "waybill ship_month invoice_month", "select * from {recon}")
check("client_fallback", "waybill client", "select * from {recon}")
check("reconcile", RECON, "select * from {recon}")

# --- pricing --------------------------------------------------------------------------------
COST_RATE = "carrier zone kilo_min kilo_max cost:n valid_from:d valid_to:d service"
check(
    "validity_window", f"{COST_RATE} is_valid",
    f"select *, {_VALID.format(day=AS_OF)} as is_valid from {{cost_rates}} r",
)
check(
    "kilo_band", "carrier zone kilo_min kilo_max at_5 at_9_99 at_20 at_45",
    f"""select *, {_BAND.format(kilo=5.0)} as at_5, {_BAND.format(kilo=9.99)} as at_9_99,
      {_BAND.format(kilo=20.0)} as at_20, {_BAND.format(kilo=45.0)} as at_45
    from {{cost_rates}} r""",
)
LINE = "waybill carrier zone service kilos ship_date:d"
check(
    "lookup_cost", f"{LINE} unit_cost:n",
    "select b.*, c.unit_cost from {first_line} b left join {cost_pick} c on c.waybill = b.waybill",
)
check(
    "lookup_fuel", f"{LINE} fuel:n",
    """select b.*, coalesce(c.fuel, 0) as fuel
    from {first_line} b left join {fuel_pick} c on c.waybill = b.waybill""",
)
check(
    "lookup_zone_margin", "waybill seller_id zone zone_margin:n",
    """select a.*, coalesce(z.margin, 0) as zone_margin from {accounts} a
    left join {zone_unique} z on z.seller_id = a.seller_id and z.zone = a.zone""",
)
check(
    "lookup_kilo_margin", "waybill seller_id kilos kilo_margin:n",
    """select a.*, coalesce(k.margin, 0) as kilo_margin from {accounts} a
    left join {account_kilo} k on k.waybill = a.waybill""",
)
check(
    "lookup_flat", "waybill seller_id carrier zone kilos ship_date:d flat_price:n",
    """select a.*, f.price as flat_price from {accounts} a
    left join {account_flat} f on f.waybill = a.waybill""",
)
check(
    "price", "waybill method tariff_price:n",
    "select waybill, billing_method as method, tariff_price from {tariffed}",
)

STEPS["config_after"] = """
select seller_id, client, method, value, note, margin, credit_days from {credit_config}
where seller_id not in (select seller_id from {config_changes})
union all
select n.seller_id, coalesce(nullif(n.client, ''), o.client),
  coalesce(nullif(n.method, ''), case when o.seller_id is null then 'automatic' else o.method end),
  null, null, case when n.margin_sent then n.margin else o.margin end,
  case when n.credit_days_sent then n.credit_days else o.credit_days end
from {config_changes} n left join {credit_config} o on o.seller_id = n.seller_id"""
STEPS["changed_sellers"] = """
select a.seller_id, a.client, a.method, a.margin
from {config_after} a left join {credit_config} b on b.seller_id = a.seller_id
where (a.method is distinct from b.method or coalesce(a.margin, 0) <> coalesce(b.margin, 0))
  and a.method is distinct from 'automatic' and a.margin is not null"""
STEPS["preview_clients"] = f"""
select c.seller_id, r.carrier, {_METHOD} as billing_method, c.margin as client_margin
from {{changed_sellers}} c join {{client_carriers}} r on r.seller_id = c.seller_id
where {_METHOD} like 'margin%'"""
STEPS["preview_rows"] = f"""
select row_number() over () as row_id, p.*, r.zone, r.kilo_min, r.kilo_max, r.cost, r.service
from {{preview_clients}} p join {{cost_rates}} r on r.carrier = p.carrier
where {_VALID.format(day=AS_OF)}"""
_START = "coalesce(b.kilo_min, 0)"
STEPS["preview_keys"] = """select distinct seller_id, carrier, zone, kilo_min, service from {preview_rows}"""
STEPS["preview_numbered"] = "select row_number() over () as key_id, * from {preview_keys}"
STEPS["preview_cost"] = _best_cost("preview_numbered", "b.key_id", _START, AS_OF)
STEPS["preview_fuel"] = _best_fuel("preview_numbered", "b.key_id", AS_OF)
STEPS["preview_kilo"] = _best_kilo("preview_numbered", "b.key_id", _START)
STEPS["preview"] = f"""
select a.seller_id, a.carrier, a.billing_method as method, a.service, a.zone, a.kilo_min, a.kilo_max,
  a.cost, coalesce(u.fuel, 0) as fuel,
  cast({_price_of('a.billing_method', 'a.client_margin').replace('f.price', 'a.cost')}
    as decimal(18,2)) as price
from {{preview_rows}} a
join {{preview_numbered}} n on n.seller_id = a.seller_id and n.carrier = a.carrier
  and n.zone = a.zone and n.kilo_min is not distinct from a.kilo_min
  and n.service is not distinct from a.service
left join {{preview_cost}} c on c.key_id = n.key_id
left join {{preview_fuel}} u on u.key_id = n.key_id
left join {{preview_kilo}} k on k.key_id = n.key_id
left join {{zone_unique}} z on z.seller_id = a.seller_id and z.zone = a.zone"""
PREVIEW = "seller_id carrier method service zone kilo_min kilo_max cost:n fuel:n price:n"
check("tariff_preview", PREVIEW, "select * from {preview}")
# the same chain for every client after the changes: a full re-price
STEPS["every_clients"] = f"""
select c.seller_id, r.carrier, {_METHOD} as billing_method, c.margin as client_margin
from (
  select seller_id, method, margin from {{changed_sellers}}
  union all
  select seller_id, method, margin from {{credit_config}}
  where seller_id not in (select seller_id from {{changed_sellers}})) c
join {{client_carriers}} r on r.seller_id = c.seller_id
where {_METHOD} like 'margin%'"""
for _step in ("rows", "keys", "numbered", "cost", "fuel", "kilo"):
    STEPS[f"every_{_step}"] = STEPS[f"preview_{_step}"].replace("preview_", "every_")
STEPS["every"] = STEPS["preview"].replace("preview_", "every_")
check("reprice", PREVIEW, "select * from {every}")
check(
    "tariff_preview_flat", PREVIEW,
    """select r.seller_id, r.carrier, 'flat' as method, cast(null as varchar) as service, r.zone,
      r.kilo_min, r.kilo_max, cast(null as double) as cost, 0 as fuel,
      cast(cast(r.price as decimal(24,6)) * 1.16 as decimal(18,2)) as price
    from {flat_rates} r join {credit_config} c on c.seller_id = r.seller_id
    where c.method in ('flat', 'manual')""",
)
_SERVICE_NAME = """case when carrier = 'dhl' and service = 'G' then 'ECONOMY SELECT DOMESTIC'
  when carrier = 'dhl' and service = 'N' then 'EXPRESS DOMESTIC'
  when carrier = 'fedex' and service = 'Express Saver' then 'EXPRESS SAVER'
  when carrier = 'paquete_express' and service = 'Standard' then 'STANDARD'
  when service <> '' then service else 'GENERAL' end"""
_BAND_LABEL = """case when kilo_min is null and kilo_max is null then '—'
  when kilo_max - kilo_min = 1 and kilo_min = floor(kilo_min)
    then cast(cast(kilo_min as bigint) as varchar) || ' kg'
  else coalesce(cast(kilo_min as varchar), '0') || ' a ' || coalesce(cast(kilo_max as varchar), '∞')
  end"""
_ZONES = ("0", "1", "2", "3", "4", "5", "6", "EXT")
check(
    "tariff_matrix",
    "seller_id carrier service_name service kilo_min kilo_max band "
    + " ".join(f"zone_{z}:n" for z in _ZONES),
    f"""select seller_id, carrier, {_SERVICE_NAME} as service_name, service, kilo_min, kilo_max,
      {_BAND_LABEL} as band,
      {', '.join(f"max(price) filter (zone = '{z}') as zone_{z}" for z in _ZONES)}
    from {{preview}} group by seller_id, carrier, service, kilo_min, kilo_max""",
)
check(
    "zone_order", "carrier zone",
    """select distinct carrier, zone, try_cast(zone as int) as number from {cost_rates}
    order by carrier, number is null, number, zone""",
)
check(
    "band_label", "kilo_min kilo_max band",
    f"""select *, {_BAND_LABEL} as band from (
      select kilo_min, kilo_max from {{cost_rates}}
      union all select kilo_min, kilo_min + 1 from {{cost_rates}})""",
)
check(
    "service_name", "carrier service service_name",
    f"select carrier, service, {_SERVICE_NAME} as service_name from {{cost_rates}}",
)
check(
    "fuel_today", "carrier service pct:n valid_from:d valid_to:d",
    f"""select carrier, coalesce(service, '') as service, pct, valid_from, valid_to
    from {{fuel_rates}} r where {_VALID.format(day=AS_OF)}""",
)
VERSION = (
    "seller_id client carrier version method margin:n vat:n valid_from:d valid_to:d path filename "
    "bytes created_at:t"
)
check(
    "tariff_version", VERSION,
    """select n.*, cast(coalesce((select max(version) from {tariff_versions} h
      where h.seller_id = n.seller_id), 0) + 1 as int) as version from {new_tariffs} n""",
)
check("tariff_history", VERSION, "select * from {tariff_versions}")
check(
    "repriced_versions", VERSION,
    """select n.seller_id, c.client, n.carrier, cast(coalesce((select max(version) from {tariff_versions} h
        where h.seller_id = n.seller_id), 0) + n.step as int) as version, n.method, c.margin,
      cast(0.16 as decimal(9,6)) as vat, date '1999-03-15' as valid_from, cast(null as date) as valid_to,
      concat('tariffs/', n.seller_id, '/', n.carrier) as path, 'tariff ' || c.client as filename, n.bytes,
      timestamp '2002-02-01 08:00:00' as created_at
    from (select seller_id, carrier, method, count(*) as bytes,
        row_number() over (partition by seller_id order by carrier) as step
      from {preview} group by seller_id, carrier, method) n
    join {changed_sellers} c on c.seller_id = n.seller_id""",
)

# --- reports --------------------------------------------------------------------------------
_PCT = "round(cast(100.0::double * cast({0} as double) / nullif(cast({1} as double), 0) as decimal(28,9)), 1)"
# amounts a report sums, one row each: what was realised, is due, is to accrue, came back
STEPS["ledger"] = """
select 'income' as kind, income as amount, client, status, ship_month, account_type
from {recon} where cost is not null and income is not null
union all
select 'profit', income - cost, client, status, ship_month, account_type
from {recon} where cost is not null and income is not null
union all
select 'due', extra, client, status, ship_month, account_type
from {recon} where status = 'extra_due' and extra is not null
union all
select 'due', cost - coalesce(income, 0), client, status, ship_month, account_type
from {recon} where status = 'credit_unbilled'
union all
select 'accrue', income, client, status, ship_month, account_type
from {recon} where cost is null and income is not null
union all
select 'returned', cost, client, status, ship_month, account_type from {recon} where is_return
union all
select 'unbilled', cost, client, status, ship_month, account_type from {recon} where income is null"""


def _ledger(key: str, where: str = "true", **kinds: str) -> str:
    """Sums of the named kinds by a key."""
    sums = ", ".join(
        f"coalesce(sum(amount) filter (kind = '{kind}'), 0) as {name}" for name, kind in kinds.items()
    )
    return f"""(select {key} as key, {sums}, count(*) filter (kind = 'returned') as n_returned
  from {{ledger}} where {where} group by 1)"""


_REALISED = {"income": "income", "receivable": "due", "to_accrue": "accrue"}
_TOTALS = "count(*) as waybills, sum(cost) as cost, sum(income) as income, sum(income) - sum(cost) as margin"
TOTALS = "waybills cost:n income:n margin:n"
check(
    "summary_by_status", f"status {TOTALS}",
    f"select status, {_TOTALS} from {{recon}} group by status",
)
check(
    "pipeline_summary", f"status {TOTALS}",
    f"select status, {_TOTALS} from {{raw_recon}} group by status",
)
check(
    "kpis", "waybills cost:n income:n margin:n receivable:n to_accrue:n",
    f"""select t.*, income, profit as margin, receivable, to_accrue
    from (select 'all' as key, count(*) as waybills, sum(cost) as cost from {{recon}}) t
    left join {_ledger("'all'", **_REALISED, profit='profit')} l on l.key = t.key""",
)
STEPS["client_recharges"] = """
select client, sum(r.recharges) as recharges from (
  select distinct client, seller_id from {recon} where account_type = 'prepaid') p
join {recharges} r on r.seller_id = p.seller_id group by client"""


def _clients(kind: str) -> str:
    """Sums by client of one account type, with what came back."""
    back = _ledger("client", f"account_type = '{kind}'", return_cost="returned", unbilled_cost="unbilled")
    return f"""(select t.*, coalesce(l.return_cost, 0) as return_cost,
    coalesce(l.n_returned, 0) as return_waybills, coalesce(l.unbilled_cost, 0) as unbilled_cost
  from (select client, count(*) as waybills, sum(cost) as cost, coalesce(sum(income), 0) as income,
      coalesce(sum(extra), 0) as extra, coalesce(sum(surcharges), 0) as surcharges,
      sum(overweight_billed) as overweight
    from {{recon}} where account_type = '{kind}' group by client) t
  left join {back} l on l.key is not distinct from t.client)"""


check(
    "prepaid_clients",
    "client waybills cost:n income:n margin:n margin_pct:n extra:n overweight:n return_cost:n "
    "return_waybills recharges:n",
    f"""select t.*, income - cost as margin, {_PCT.format('(income - cost)', 'cost')} as margin_pct,
      g.recharges
    from {_clients('prepaid')} t left join {{client_recharges}} g on g.client = t.client""",
)
check(
    "credit_clients",
    "client waybills cost:n billed:n unbilled_cost:n surcharges:n overweight:n return_cost:n "
    "return_waybills",
    f"select *, income as billed from {_clients('credit')}",
)
_MATCH = "status = 'extra_due' and client ilike '%customer%' and waybill ilike '%1%'"
check(
    "search_waybills",
    "waybill carrier client account_type status is_return cost:n sale_price:n overweight:n extra:n "
    "surcharges:n income:n margin:n ship_month",
    f"""select *, overweight_billed as overweight from {{recon}} where {_MATCH}
    order by cost desc nulls last, waybill limit 100 offset 20""",
)
check(
    "search_pages",
    "waybill carrier client account_type status is_return cost:n sale_price:n overweight:n extra:n "
    "surcharges:n income:n margin:n ship_month",
    """select *, overweight_billed as overweight from {recon}
    where status = 'extra_due' and client ilike '%customer%' and waybill ilike '%001%'
    order by cost desc nulls last, waybill limit 100 offset 20""",
)
check("search_total", "total", f"select count(*) as total from {{recon}} where {_MATCH}")
check(
    "month_range_filter", "ship_month waybills",
    """select ship_month, count(*) as waybills from {recon}
    where ship_month >= '1996-03' and ship_month <= '1999-10' group by ship_month""",
)
check(
    "receivable", "client status waybills cost:n amount_due:n",
    """select t.*, coalesce(d.amount, 0) as amount_due
    from (select client, status, count(*) as waybills, sum(cost) as cost from {recon}
      where status in ('extra_due', 'credit_unbilled') group by client, status) t
    left join (select client, status, sum(amount) as amount from {ledger} where kind = 'due'
      group by client, status) d on d.client is not distinct from t.client and d.status = t.status""",
)
check(
    "close_months",
    "month waybills cost:n income:n profit:n receivable:n to_accrue:n closed_at:t status",
    f"""select t.*, coalesce(l.income, 0) as income, coalesce(l.profit, 0) as profit,
      coalesce(receivable, 0) as receivable, coalesce(to_accrue, 0) as to_accrue, p.closed_at,
      coalesce(p.status, 'open') as status
    from (select ship_month as month, count(*) as waybills, sum(cost) as cost from {{recon}}
      where ship_month is not null group by ship_month) t
    left join {_ledger('ship_month', **_REALISED, profit='profit')} l on l.key = t.month
    left join {{periods}} p on p.month = t.month""",
)
check(
    "close_detail", "client carrier waybills cost:n billed:n margin:n",
    """select *, billed - coalesce(cost, 0) as margin from (
      select client, carrier, count(*) as waybills, sum(cost) as cost,
        coalesce(sum(income), 0) as billed
      from {recon} where ship_month = '1999-01' group by client, carrier)""",
)
check(
    "close_month", "month status cost:n income:n profit:n closed_at:t",
    """select month, status, cost, income, profit, closed_at from {periods} where month <> '1998-12'
    union all
    select '1998-12', 'closed', sum(cost), sum(income), sum(coalesce(income - cost, 0)),
      timestamp '2002-02-01 08:00:00'
    from {recon} where ship_month = '1998-12'""",
)
check(
    "reopen_month", "month status cost:n income:n profit:n closed_at:t",
    """select * from {periods}
    where month not in (select month from {status_changes} where month > '1998-06')""",
)
STEPS["credit_sellers"] = """
select seller_id, min(client) as client, count(*) as waybills, sum(cost) as cost
from {recon} where account_type = 'credit' group by seller_id"""
check(
    "credit_config_overview", "seller_id client waybills cost:n method value:n note",
    """select s.*, c.method, c.value, c.note from {credit_sellers} s
    left join {credit_config} c on c.seller_id = s.seller_id""",
)
check(
    "tariff_clients", "seller_id client waybills cost:n method margin:n credit_days flat_rows",
    """select s.*, coalesce(c.method, 'automatic') as method, c.margin, c.credit_days,
      (select count(*) from {flat_rates} f where f.seller_id = s.seller_id) as flat_rows
    from {credit_sellers} s left join {credit_config} c on c.seller_id = s.seller_id""",
)
check(
    "collections_worklist", "client account_type waybills cost:n billed:n shortfall:n billed_pct:n",
    f"""select *, cost - billed as shortfall, {_PCT.format('billed', 'cost')} as billed_pct from (
      select client, min(account_type) as account_type, count(*) as waybills, sum(cost) as cost,
        coalesce(sum(income), 0) as billed
      from {{recon}} where account_type in ('prepaid', 'credit') group by client)
    where cost - billed > 1""",
)
check(
    "by_client", f"client account_type {TOTALS} margin_pct:n",
    f"""select client, min(account_type) as account_type, {_TOTALS},
      {_PCT.format('(sum(income) - sum(cost))', 'sum(cost)')} as margin_pct
    from {{recon}} group by client""",
)
check(
    "by_ship_month", f"ship_month {TOTALS}",
    f"select ship_month, {_TOTALS} from {{recon}} group by ship_month",
)
_ACTIONABLE = """select client, status, count(*) as waybills, sum(cost) as carrier_cost,
  sum(cost) - sum(coalesce(income, 0)) as uncollected
from {recon} where status in ('credit_unbilled', 'extra_due') group by client, status"""
check("actionable", "client status waybills carrier_cost:n uncollected:n", _ACTIONABLE)
check(
    "report_bundle", "report row_count waybills cost:n",
    " union all ".join(
        f"""select '{name}' as report, count(*) as row_count, cast(sum(waybills) as bigint) as waybills,
          sum(cost) as cost from ({body})"""
        for name, body in (
            *(
                (name, f"select {key}, {_TOTALS} from {{recon}} group by {key}")
                for name, key in (
                    ("summary_by_status", "status"), ("by_client", "client"),
                    ("by_ship_month", "ship_month"),
                )
            ),
            ("actionable", f"select *, carrier_cost as cost from ({_ACTIONABLE})"),
        )
    ),
)
check(
    "table_counts", "table_name row_count",
    " union all ".join(
        f"select '{t}' as table_name, count(*) as row_count from {{{t}}}"
        for t in ("carrier_invoices", "shipments", "overweight", "surcharges", "charges")
    ),
)
check(
    "services", "carrier service",
    """select carrier, service from {carrier_invoices} where service <> ''
    union select carrier, service from {cost_rates} where service <> ''""",
)
for _name, _columns in {
    "cost_rates": COST_RATE,
    "flat_rates": "seller_id client carrier zone kilo_min kilo_max price:n valid_from:d valid_to:d",
    "fuel_rates": "carrier valid_from:d valid_to:d pct:n service",
    "surcharge_map": "carrier concept source_column",
    "zone_margins": "seller_id zone margin:n",
    "kilo_margins": "seller_id kilo_min kilo_max margin:n",
    "client_carriers": "seller_id carrier",
}.items():
    check(f"list_{_name}", _columns, f"select * from {{{_name}}}")

# --- receivables ----------------------------------------------------------------------------
STEPS["chargeable"] = """
select seller_id, client, ship_month as month, 'credit' as account_type, 'invoice' as concept,
  income as amount, 1 as counted, 0 as more_than
from {recon} where account_type = 'credit' and income is not null
union all
select seller_id, client, ship_month, 'prepaid', 'extra', extra, case when extra > 0.5 then 1 end, 0.5
from {recon} where account_type = 'prepaid'"""
STEPS["generated"] = """
select seller_id, min(client) as client, month, account_type, concept, count(counted) as waybills,
  sum(amount) as amount
from {chargeable} where seller_id is not null and month is not null
group by seller_id, month, account_type, concept having sum(amount) > max(more_than)"""
check(
    "generate_charges", "seller_id client month account_type concept waybills amount:n",
    "select * from {generated}",
)
CHARGE = (
    "seller_id client month waybills amount:n status generated_at:t note account_type concept "
    "paid_amount:n sent_date:d due_date:d"
)
STEPS["generated_once"] = """select * from {generated}
qualify row_number() over (partition by seller_id, month order by amount, account_type) = 1"""
check(
    "merge_charges", CHARGE,
    """select c.seller_id, coalesce(g.client, c.client) as client, c.month,
      coalesce(g.waybills, c.waybills) as waybills, coalesce(g.amount, c.amount) as amount,
      c.status, c.generated_at, c.note, coalesce(g.account_type, c.account_type) as account_type,
      coalesce(g.concept, c.concept) as concept, c.paid_amount, c.sent_date, c.due_date
    from {charges} c left join {generated_once} g on g.seller_id = c.seller_id and g.month = c.month
    where g.seller_id is not null or c.status <> 'generated'
    union all
    select g.seller_id, g.client, g.month, g.waybills, g.amount, 'generated',
      timestamp '2002-02-01 08:00:00', null, g.account_type, g.concept, 0, null, null
    from {generated_once} g
    where not exists (
      select 1 from {charges} c where c.seller_id = g.seller_id and c.month = g.month)""",
)
check(
    "charge_totals", "month sellers total_amount:n",
    "select month, count(*) as sellers, sum(amount) as total_amount from {charges} group by month",
)


def _paid(payments: str) -> str:
    return (
        "select seller_id, month, cast(sum(amount) as decimal(18,2)) as paid "
        f"from ({payments}) group by seller_id, month"
    )


STEPS["paid"] = _paid("select * from {payments}")
check(
    "list_charges",
    "seller_id month client account_type concept waybills amount:n paid:n balance:n status "
    "sent_date:d due_date:d days_overdue has_attachment",
    f"""select c.*, coalesce(p.paid, 0) as paid, c.amount - coalesce(p.paid, 0) as balance,
      cast(case when c.due_date is not null and c.status <> 'paid' and {AS_OF} > c.due_date
        then date_diff('day', c.due_date, {AS_OF}) else 0 end as int) as days_overdue,
      exists (select 1 from {{attachments}} a
        where a.seller_id = c.seller_id and a.month = c.month) as has_attachment
    from {{charges}} c left join {{paid}} p on p.seller_id = c.seller_id and p.month = c.month""",
)
check(
    "send_charges", CHARGE,
    f"""select c.* replace (
        case when s.month is null then c.status when c.status = 'paid' then 'paid'
          when coalesce(c.paid_amount, 0) > 0 then 'partial' else 'sent' end as status,
        case when s.month is null then c.sent_date else s.sent_on end as sent_date,
        case when s.month is null then c.due_date else s.sent_on
          + cast(case when coalesce(g.credit_days, 0) = 0 then 30 else g.credit_days end as int)
          end as due_date)
    from {{charges}} c
    left join (select seller_id, month, coalesce(max(sent_on), {AS_OF}) as sent_on
      from {{sent_changes}} group by seller_id, month) s
      on s.seller_id = c.seller_id and s.month = c.month
    left join {{credit_config}} g on g.seller_id = c.seller_id""",
)
_STATE = """case when coalesce(p.paid, 0) >= coalesce(c.amount, 0) - 0.5 then 'paid'
  when coalesce(p.paid, 0) > 0 then 'partial'
  when c.status in ('generated', 'sent', 'approved') then c.status else 'sent' end"""
check(
    "recompute_charges", CHARGE,
    f"""select c.* replace (coalesce(p.paid, 0) as paid_amount, {_STATE} as status)
    from {{charges}} c left join {{paid}} p on p.seller_id = c.seller_id and p.month = c.month""",
)


def _balances(payments: str, touched: str) -> str:
    return f"""select c.seller_id, c.month, c.amount, coalesce(p.paid, 0) as paid,
      coalesce(c.amount, 0) - coalesce(p.paid, 0) as balance,
      case when exists (select 1 from {{{touched}}} t
        where t.seller_id = c.seller_id and t.month = c.month) then {_STATE} else c.status end as status
    from {{charges}} c left join ({_paid(payments)}) p
      on p.seller_id = c.seller_id and p.month = c.month"""


BALANCE = "seller_id month status amount:n paid:n balance:n"
check(
    "record_payments", BALANCE,
    _balances("select * from {payments} union all select * from {new_payments}", "new_payments"),
)
check("payment_history", PAYMENT, "select * from {payments}")
check(
    "void_payments", BALANCE,
    _balances(
        """select * from {payments}
        where payment_id not in (select payment_id from {voided_payments})""",
        "voided_payments",
    ),
)
check(
    "override_status", CHARGE,
    """select c.* replace (case when exists (select 1 from {status_changes} s
      where s.seller_id = c.seller_id and s.month = c.month) then 'approved' else c.status end as status)
    from {charges} c""",
)
check(
    "charge_detail",
    "seller_id month position waybill ship_date:d service destination kilos zone is_return amount:n",
    """select *, cast(place as int) as position from (
      select r.seller_id, r.ship_month as month, r.waybill, l.ship_date, l.service, l.destination,
        l.kilos, l.zone, r.is_return,
        case when c.concept = 'extra' then r.extra else r.income end as amount,
        row_number() over (partition by r.seller_id, r.ship_month order by
          case when c.concept = 'extra' then r.extra else r.income end desc nulls last, r.waybill)
          as place
      from {recon} r join {charges} c on c.seller_id = r.seller_id and c.month = r.ship_month
      join {first_line_detail} l on l.waybill = r.waybill
      where c.concept <> 'extra' or r.extra > 0.5)""",
)
_SPLIT = """cast(round(total / 1.16, 2) as decimal(18,2)) as subtotal,
  total - cast(round(total / 1.16, 2) as decimal(18,2)) as tax"""
STEPS["statement_rows"] = """
select r.seller_id, r.ship_month as month, r.waybill, coalesce(c.concept, '') = 'extra' as is_extra,
  coalesce(case when c.concept = 'extra' then r.extra
    else r.income - coalesce(r.surcharges, 0) end, 0) as total
from {recon} r left join {charges} c on c.seller_id = r.seller_id and c.month = r.ship_month
where r.seller_id is not null and (coalesce(c.concept, '') <> 'extra' or r.extra > 0.5)"""
STEPS["statement_lines"] = f"""
select s.seller_id, s.month, s.total, l.*, {_SPLIT}
from {{statement_rows}} s join {{first_line_statement}} l on l.waybill = s.waybill"""
check(
    "client_statement",
    "seller_id month carrier waybill reference service origin destination zone pieces kilos "
    "billable_kilos ship_date:d freight:n other_costs:n subtotal:n tax:n total:n insurance:n tax_pct "
    "currency exchange_rate sender recipient",
    """select * replace (subtotal as freight, tax as tax, 0 as insurance, 'MXN' as currency),
      cast(ceil(kilos) as int) as billable_kilos, 0 as other_costs, 16 as tax_pct, 1 as exchange_rate
    from (select * exclude (tax), tax_1 as tax from {statement_lines})""",
)
STEPS["surcharge_lines"] = f"""
select x.*, {_SPLIT} from (
  select t.seller_id, t.month, t.carrier, t.concept,
    cast(t.cost * cast(1 + coalesce(g.margin, 0) as decimal(20,6)) * 1.16 as decimal(18,2)) as total
  from (select s.seller_id, s.month, u.carrier, u.concept,
      cast(sum(u.amount) as decimal(18,2)) as cost
    from {{statement_rows}} s join {{surcharges}} u on u.waybill = s.waybill
    where not s.is_extra group by s.seller_id, s.month, u.carrier, u.concept) t
  left join {{credit_config}} g on g.seller_id = t.seller_id) x
where total <> 0 and exists (select 1 from {{statement_lines}} l
  where l.seller_id = x.seller_id and l.month = x.month and l.carrier = x.carrier)"""
check(
    "statement_surcharges", "seller_id month carrier concept subtotal:n tax:n total:n",
    "select * from {surcharge_lines}",
)
check(
    "statement_totals", "seller_id month carrier total:n",
    """select seller_id, month, carrier, sum(total) as total from (
      select seller_id, month, carrier, total from {statement_lines}
      union all select seller_id, month, carrier, total from {surcharge_lines})
    group by seller_id, month, carrier""",
)
check(
    "update_credit_config", "seller_id client method value:n note margin:n credit_days",
    "select * from {config_after}",
)
check(
    "config_changed", "seller_id client method margin:n", "select * from {changed_sellers}",
)
check(
    "set_attachment", "seller_id month filename path uploaded_at:t",
    """select seller_id, month, filename, path, uploaded_at from {new_attachments}
    qualify row_number() over (
      partition by seller_id, month order by uploaded_at desc, filename desc, path desc) = 1
    union all
    select seller_id, month, filename, path, uploaded_at from {attachments} a
    where not exists (select 1 from {new_attachments} n
      where n.seller_id = a.seller_id and n.month = a.month)""",
)

for _name, _same in (
    ("status_rollup", "summary_by_status"), ("kpis_rollup", "kpis"), ("months_rollup", "close_months"),
    ("clients_rollup", "by_client"),
):
    CHECKS[_name] = CHECKS[_same]
check(
    "upsert_charges", CHARGE,
    """select c.seller_id, coalesce(g.client, c.client) as client, c.month,
      coalesce(g.waybills, c.waybills) as waybills, coalesce(g.amount, c.amount) as amount,
      c.status, c.generated_at, c.note, coalesce(g.account_type, c.account_type) as account_type,
      coalesce(g.concept, c.concept) as concept, c.paid_amount, c.sent_date, c.due_date
    from {charges} c
    left join (select * from {generated_once} where month = '1999-01') g
      on g.seller_id = c.seller_id and g.month = c.month
    where g.seller_id is not null or c.status <> 'generated' or c.month <> '1999-01'
    union all
    select g.seller_id, g.client, g.month, g.waybills, g.amount, 'generated',
      timestamp '2002-02-01 08:00:00', null, g.account_type, g.concept, 0, null, null
    from {generated_once} g where g.month = '1999-01'
    and not exists (select 1 from {charges} c where c.seller_id = g.seller_id and c.month = g.month)""",
)
