"""Query plans: the dashboard's tables composed from operators over the
parquet tables, plus the independent SQL each is checked against."""
