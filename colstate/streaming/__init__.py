"""Streaming of colstate."""
