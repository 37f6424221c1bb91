"""Ondelys sources."""
