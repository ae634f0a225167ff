"""Training-data operators: filters, tokenisation, deduplication, packing and PII, as Spark jobs."""
