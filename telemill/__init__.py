"""Agent-telemetry analytics on Spark: lazy DataFrame operators for batch and streaming."""
