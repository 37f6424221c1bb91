"""Ondelys functions."""
