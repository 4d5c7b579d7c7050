"""Readers, structural validation, manifests, stored tables."""
