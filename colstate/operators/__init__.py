"""Operators of colstate."""
