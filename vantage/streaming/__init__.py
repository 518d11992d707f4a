"""Structured Streaming forms of sightings, entries, follow-ups, flow windows and monitoring."""
