"""Catalogs of fixed values."""
