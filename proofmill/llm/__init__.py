"""Training-data operators: deduplication, decontamination, quality, tokenisation and sharding of a corpus."""
