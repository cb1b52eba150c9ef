"""Structured Streaming: validation with a dead-letter output, keyed state, and pipelines."""
