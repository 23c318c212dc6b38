"""Relational, windowed and iterative operators over melody tables."""
