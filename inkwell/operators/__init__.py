"""Index and ranking operators."""
