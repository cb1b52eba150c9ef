"""Training-data operators: URL filters, fingerprints, extraction, near-duplicates, token files, archives,
quality, decontamination, tokenization and license scans. Nothing else in the library imports this subpackage."""
