"""operators of the photo-archive engine."""
