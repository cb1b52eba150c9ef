"""YAML configuration."""

from __future__ import annotations

from pathlib import Path
from typing import Any


def load_config(path: str) -> dict[str, Any]:
    """The file as a dict; a missing file raises FileNotFoundError."""
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}
