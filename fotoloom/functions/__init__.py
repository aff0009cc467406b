"""functions of the photo-archive engine."""
