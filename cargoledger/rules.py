"""Business rules, frozen in one place and passed to the operators that need them."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

# Pricing methods, the cost-plus subset, and the legacy alias.
AUTOMATIC = "automatic"
FLAT = "flat"
MARGIN_GLOBAL, MARGIN_ZONE, MARGIN_KILO = MARGIN_METHODS = ("margin_global", "margin_zone", "margin_kilo")
METHODS = (AUTOMATIC, *MARGIN_METHODS, FLAT)
LEGACY_FLAT = "manual"

# Life cycle of a charge.
GENERATED, SENT, PARTIAL, PAID, APPROVED = "generated", "sent", "partial", "paid", "approved"


@dataclass(frozen=True)
class Rules:
    # internal accounts: exact names, then name fragments, each with its agreed margin
    internal_accounts: tuple[tuple[str, Decimal], ...] = (
        ("SN00449", Decimal("0.14")),
        ("SE00724", Decimal("0.14")),
    )
    internal_fragments: tuple[tuple[str, Decimal], ...] = (("INBURSA", Decimal("0.14")),)
    extra_margin: Decimal = Decimal("0.14")
    vat: Decimal = Decimal("0.16")
    credit_days: int = 30
    prepaid_model: str = "Prepago"
    credit_model: str = "Prepago sin saldo"
    default_carrier: str = "dhl"
    extra_tolerance: Decimal = Decimal("0.5")
    payment_tolerance: Decimal = Decimal("0.5")
    overweight_type: str = "Cargo por sobrepeso"
    # carrier account -> carrier name in the warehouse; two accounts share one name
    warehouse_carriers: dict[str, str] = field(
        default_factory=lambda: {
            "dhl": "DHL",
            "fedex": "FEDEX",
            "paquete_express": "PAQUETERIA EXPRESS",
            "paquete_express_2": "PAQUETERIA EXPRESS",
        }
    )


DEFAULT_RULES = Rules()
