"""Analytics on metered telemetry, batch and streaming, on Spark."""
