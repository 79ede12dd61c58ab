"""A Spark-native analytics engine for temporal subscription-product data."""
