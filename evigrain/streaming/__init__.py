"""evigrain streaming."""
