"""Plan helpers (size checks, skew, sort keys) and the registered query catalog."""
