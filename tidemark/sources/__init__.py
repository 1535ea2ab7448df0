"""Readers, writers and the input builders over the shared test tables."""
