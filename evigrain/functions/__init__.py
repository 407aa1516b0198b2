"""evigrain functions."""
