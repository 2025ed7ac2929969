"""rillhouse: a Spark-native real-time warehouse engine (DataFrame in, DataFrame out)."""
