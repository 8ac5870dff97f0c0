"""A PySpark-native analytics engine for registries of reusable components."""
