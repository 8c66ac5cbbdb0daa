"""Sources (parquet tables, wide CSV) and sinks (CSV / parquet exports)."""
