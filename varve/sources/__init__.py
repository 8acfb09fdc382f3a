"""Where version logs live."""
