"""Batch operators on event logs."""
