"""docsignal: a Spark-native engine that screens document collections for call-home signals and per-recipient fingerprints."""

__version__ = "0.1.0"
