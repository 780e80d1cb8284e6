"""Readers and writers of event logs, revisions, drops and snapshots."""
