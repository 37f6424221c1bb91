"""Ondelys signal."""
