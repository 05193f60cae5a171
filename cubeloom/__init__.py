"""A Spark-native engine for experiment cubes."""
