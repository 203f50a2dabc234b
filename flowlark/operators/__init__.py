"""Operators of the packet-flow engine."""
