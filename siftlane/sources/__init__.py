"""Readers: the event log, stored artifacts, media files."""
