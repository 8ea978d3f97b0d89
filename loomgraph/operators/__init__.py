"""Relational, rule and graph operators over the code-graph tables."""
