"""Registered queries: name to (callable, oracle SQL or None)."""
