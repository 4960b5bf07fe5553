"""Streaming views."""
