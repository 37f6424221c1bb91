"""Ondelys operators."""
