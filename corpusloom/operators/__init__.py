"""Relational operators: alignment, quality rules, profiles, retrieval, prompts, metrics."""
