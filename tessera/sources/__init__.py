"""Readers of files, manifests, lists and settings."""
