"""Column expressions that the operators share."""

from .expressions import clock_sin_cos, count_present, flag, log1p_floor, safe_ratio, sha256_of

__all__ = ["clock_sin_cos", "count_present", "flag", "log1p_floor", "safe_ratio", "sha256_of"]
