"""Plans of colstate."""
