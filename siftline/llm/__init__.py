"""Training-data operators: scoring, fingerprints, scans, writers, mixing, sharding and duplicate removal."""
