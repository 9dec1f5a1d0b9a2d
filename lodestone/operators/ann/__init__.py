"""Approximate vector indexes, all as tables. Each is fitted on a bounded sample where it needs fitting, holds every row, and ranks its candidates by exact similarity."""
