"""ashlar: a Spark-native analytics engine."""
