"""Lodestrum: search, catalogue and signal analytics expressed as Spark plans."""
