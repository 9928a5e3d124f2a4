"""Streams of changed documents."""
