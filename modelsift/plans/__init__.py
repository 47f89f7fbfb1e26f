"""Candidates, tuning, the recommendation flow and the registered queries."""
