"""driftpool.functions."""
