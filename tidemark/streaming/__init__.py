"""Streaming forms of the keyed operators and the wiring of whole streaming jobs."""
