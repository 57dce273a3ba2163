"""verbloom: Spark-native analytics over weighted distributions, their clusterings and scores."""

__version__ = "0.1.0"
