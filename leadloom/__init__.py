"""Leadloom: turns stored web pages into deduplicated, verified business leads with PySpark."""
