"""functions of the event memory engine."""
