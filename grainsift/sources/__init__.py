"""Input tables, dirtied views of them, and named error scenarios."""
