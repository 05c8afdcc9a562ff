"""Training-data operators: language ID, PII, deduplication, packing, WARC and chat formatting."""
