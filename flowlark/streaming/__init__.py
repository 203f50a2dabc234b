"""Streaming of the packet-flow engine."""
