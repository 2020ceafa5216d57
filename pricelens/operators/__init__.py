"""Reusable DataFrame operators: joins, ordered scans, ranks, histograms, checks."""
