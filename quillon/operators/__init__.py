"""Execution: queries, changes, transactions, migration, repositories."""
