"""Registered queries with their oracle SQL, and the flagship plan."""
