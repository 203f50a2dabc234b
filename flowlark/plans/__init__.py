"""Plans of the packet-flow engine."""
