"""Reading telemetry and lookup grids, writing events and state."""
