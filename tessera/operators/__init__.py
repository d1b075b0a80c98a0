"""Relational operators on rollout tables."""
