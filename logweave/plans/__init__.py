"""From parser source text to an AST, and from an AST to DataFrame plans."""
