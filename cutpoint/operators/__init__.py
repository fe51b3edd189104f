"""Summaries, searches and evaluations over scored rows, each a DataFrame plan."""
