"""streaming of the event memory engine."""
