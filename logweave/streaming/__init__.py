"""Compiled parsers and stateful plugins on streams."""
