"""Whole feature plans, from a scan to a checked table."""

from .batch import build_card_features, build_ledger_features, card_features, ledger_features

__all__ = ["build_card_features", "build_ledger_features", "card_features", "ledger_features"]
