"""The work queue and event streams."""
