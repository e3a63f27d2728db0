"""Whole-table jobs, the test corpus, and the registered queries with their check SQL."""
