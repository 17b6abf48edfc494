"""Whole plans: corpus build, hybrid retrieval, grounding."""
