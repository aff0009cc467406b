"""sources of the photo-archive engine."""
