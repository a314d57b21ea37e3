"""Text analysis and string distance."""
