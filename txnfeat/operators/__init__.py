"""Batch operators on DataFrames."""

from .card import add_card_rowwise, prune_near_constant
from .history import CARD, LEDGER, History, add_card_history, add_history, add_ledger_history
from .ledger import add_ledger_amount_features, add_ledger_rowwise, add_ledger_temporal_features
from .subset import select_subset

__all__ = ["CARD", "History", "LEDGER", "add_card_history", "add_card_rowwise", "add_history", "add_ledger_amount_features", "add_ledger_history", "add_ledger_rowwise", "add_ledger_temporal_features", "prune_near_constant", "select_subset"]
