"""Dataset-level operators: normalisation, filters, joins, aggregates, windows and incremental state."""
