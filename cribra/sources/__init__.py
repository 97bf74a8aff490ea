"""Sources and sinks: CSV requests, whole-text files, JSON index, result CSV/JSON,
per-row text files, parquet tables."""
