"""stratal.operators."""
