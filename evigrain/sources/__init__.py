"""evigrain sources."""
