"""Landed files and catalogue tables."""
