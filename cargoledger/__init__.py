"""Freight-billing reconciliation as Spark DataFrame transformations."""

from cargoledger.rules import DEFAULT_RULES, Rules

__all__ = ["DEFAULT_RULES", "Rules"]
