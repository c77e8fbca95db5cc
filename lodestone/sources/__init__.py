"""Readers: markup, robots rules, JSON Lines, and a page data source."""
