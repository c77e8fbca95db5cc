"""Structured Streaming counterparts: incremental tables, counters, caches, cycles."""
