"""Distributed operators; each module states its method, its results and its edge cases."""
