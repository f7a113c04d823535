"""siltstone: a Spark-native content-scanning analytics engine."""
