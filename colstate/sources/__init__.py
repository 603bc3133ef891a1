"""Sources of colstate."""
