"""Incremental runs: files as they land, and state by key."""
