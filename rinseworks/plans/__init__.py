"""Strategy choice and the two multi-step cleaning plans."""
