"""Recipes: sequences of cleaning steps with a lineage log."""
