"""stratal.plans."""
