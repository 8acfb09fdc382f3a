"""Operators over version logs, transactions, locks, graphs and placements."""
