"""A PySpark-native engine for planning, ledger, scoring and text-check workloads."""
