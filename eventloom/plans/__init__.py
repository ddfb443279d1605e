"""plans of the event memory engine."""
