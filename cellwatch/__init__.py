"""Battery-pack telemetry safety analytics on PySpark."""
