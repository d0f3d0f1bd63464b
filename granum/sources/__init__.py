"""Readers and writers for the formats the engine supports."""
