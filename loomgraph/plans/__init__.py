"""Relation plans: operators as named SQL relations that build on each other."""
