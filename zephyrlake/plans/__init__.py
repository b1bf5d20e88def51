"""Submissions, lineage, command lines and the named queries."""
