"""tallywise: a Spark-native analytics engine for assistant usage logs."""
