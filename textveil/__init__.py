"""textveil: a Spark-native engine for finding, hiding and restoring personal data in text tables."""
