"""Ondelys plans."""
