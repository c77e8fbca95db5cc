"""Relational operators over tables of queries, documents and passages."""
