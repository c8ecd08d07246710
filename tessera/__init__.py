"""Spark-native schema intelligence: profile, canonicalise, govern and document tables."""
