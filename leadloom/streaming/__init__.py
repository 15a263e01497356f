"""Leads arriving over time."""
