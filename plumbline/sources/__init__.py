"""Readers and writers of tables and fitted models."""
