"""Composite flows and the catalogue of registered queries."""
