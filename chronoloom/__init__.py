"""chronoloom: a PySpark-native analytics engine for scheduling data."""
