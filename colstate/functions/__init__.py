"""Functions of colstate."""
