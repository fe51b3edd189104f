"""Extension: the histogram search over a stream. The batch interface has no such thing."""
