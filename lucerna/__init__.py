"""A Spark-native engine for semantic conjunctive queries."""
