"""Readers, writers and the adapters from tables to catalogue entities."""
