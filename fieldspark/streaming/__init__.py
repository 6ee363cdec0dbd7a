"""Edit logs, as a batch and as a stream."""
