"""Forecast blocks as a stream."""
