"""Streams of submissions and of events."""
