"""DataFrame operators of the evidence and catalog engine."""
