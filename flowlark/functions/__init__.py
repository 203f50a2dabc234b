"""Functions of the packet-flow engine."""
