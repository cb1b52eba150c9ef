"""Models on the feature tables: feature matrix, class weights, training, thresholds, ablation, scoring."""

from .features import feature_names, load_split, select_features, validate_raw_schema
from .score import score_records, score_status, score_stream, stream_counts, with_seen
from .train import Model, ablate, class_weight, fit, load_model

__all__ = ["Model", "ablate", "class_weight", "feature_names", "fit", "load_model", "load_split", "score_records", "score_status", "score_stream", "stream_counts", "select_features", "validate_raw_schema", "with_seen"]
