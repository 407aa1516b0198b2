"""evigrain operators."""
