"""driftpool.plans."""
