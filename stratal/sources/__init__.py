"""stratal.sources."""
