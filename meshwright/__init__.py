"""meshwright: a Spark-native engine for network maps and their topology."""
