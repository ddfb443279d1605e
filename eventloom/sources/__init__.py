"""sources of the event memory engine."""
