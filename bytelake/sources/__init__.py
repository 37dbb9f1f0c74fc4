"""Sources (parquet scans, fallbacks, profiles) and sinks (history, reuse)."""
