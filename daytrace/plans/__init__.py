"""Whole-day plans: reports, narratives, the derived store, and the read API."""
