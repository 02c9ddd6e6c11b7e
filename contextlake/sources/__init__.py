"""Readers: parquet tables, adapters to the engine's model, and the project-tree data source."""
