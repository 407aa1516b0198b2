"""evigrain plans."""
