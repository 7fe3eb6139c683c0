"""The safety pipeline as a stream with keyed state."""
