"""Operation logs as streams."""
