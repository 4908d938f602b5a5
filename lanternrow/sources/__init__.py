"""Readers, writers and service adapters."""
