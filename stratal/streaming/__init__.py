"""stratal.streaming."""
