"""A PySpark-native engine for hierarchical event data: runs hold sub-runs, sub-runs hold events."""
