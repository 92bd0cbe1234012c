"""Results as a stream of rows."""
