"""Readers of landed calendar data, and live ones through the Python Data Source API."""
