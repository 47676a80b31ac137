"""Sources and sinks: NDJSON metadata, API feed records, agent catalogue,
keyed Parquet tables."""
