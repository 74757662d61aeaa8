"""Geometry and graph kernels in plain Python, for what columns can't express."""
