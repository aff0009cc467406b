"""plans of the photo-archive engine."""
