"""tercet operators."""
