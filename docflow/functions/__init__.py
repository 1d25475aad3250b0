"""Part of docflow."""
