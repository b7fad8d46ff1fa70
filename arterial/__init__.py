"""A PySpark-native engine for road networks: tiles, graphs, hazards and resilience as DataFrames."""
