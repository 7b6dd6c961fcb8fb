"""Spark jobs for marketplace listings: collect, merge, clean, look up, score."""
