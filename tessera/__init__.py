"""A Spark-native engine for catalog analytics: relational, graph, vector, ranking and regression operators."""
