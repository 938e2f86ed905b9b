"""driftpool.sources."""
