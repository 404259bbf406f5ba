"""Where parsers, patterns, signatures and events come from, and where results go."""
