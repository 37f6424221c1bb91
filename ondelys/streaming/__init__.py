"""Ondelys streaming."""
