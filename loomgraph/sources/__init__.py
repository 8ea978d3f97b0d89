"""Readers that turn files and reports into code-graph tables."""
