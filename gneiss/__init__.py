"""gneiss: a Spark-native engine for text, conversation and telemetry analytics."""

__version__ = "0.1.0"
