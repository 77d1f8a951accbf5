"""Finding and masking sensitive data in logs, documents and JSON with Spark."""
