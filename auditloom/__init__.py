"""Window and graph analytics over host-provenance events, and training-data operators, on Spark."""
