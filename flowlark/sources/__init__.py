"""Sources of the packet-flow engine."""
