"""tercet sources."""
