"""Jobs put together from the operators: ingest, lookup, evaluation, export and reports."""
