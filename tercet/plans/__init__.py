"""tercet plans."""
