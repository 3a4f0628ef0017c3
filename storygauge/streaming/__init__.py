"""The ingest job driven by a stream."""
