"""Scans and sinks: Parquet tables, JSON streams, configuration and reports."""

from .config import load_config
from .parquet import load_card, load_ledger, write_checked, write_report
from .streams import replay_card, replay_ledger, sanitise, stream_sink, stream_source

__all__ = ["load_card", "load_config", "load_ledger", "replay_card", "replay_ledger", "sanitise", "stream_sink", "stream_source", "write_checked", "write_report"]
