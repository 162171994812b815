"""loomgrid: a PySpark-native engine for behavioural features, join/aggregation strategies and table layout."""
