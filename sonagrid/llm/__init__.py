"""Training-data operators: dedup, quality, packing, sharding, mixing, HTML, WARC."""
