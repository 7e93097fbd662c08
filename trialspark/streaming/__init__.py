"""Loads and metrics that go on from where the last run stopped."""
