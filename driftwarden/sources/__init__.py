"""Readers and writers: databases, staged Parquet, change logs, task logs, run history, test views."""
