"""tallyloom: a Spark-native record-linkage engine (see README.md)."""

__version__ = "0.1.0"
