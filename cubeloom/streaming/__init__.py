"""Progress monitoring, in batch and as a stream."""
