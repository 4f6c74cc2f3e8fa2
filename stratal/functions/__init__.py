"""stratal.functions."""
