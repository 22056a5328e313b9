"""A Spark-native engine for measuring how organic a body of reviews looks."""
