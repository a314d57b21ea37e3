"""Query language and its compilation."""
