"""operators of the event memory engine."""
