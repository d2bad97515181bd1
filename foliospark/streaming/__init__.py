"""Stateful operators on event streams."""
