"""Query catalogues: each query with its SQL twin."""
