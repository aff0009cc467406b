"""streaming of the photo-archive engine."""
