"""driftpool.streaming."""
