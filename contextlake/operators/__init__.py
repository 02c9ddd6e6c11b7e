"""Relational, search and graph operators over the engine's tables."""
