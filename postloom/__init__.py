"""postloom: Spark-native analytics over collected social posts."""
