"""driftpool.operators."""
