"""A Spark-native engine for asserted-structure analytics over ontologies."""
