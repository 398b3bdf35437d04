"""Scalar rules: vocabularies, messages, canonical JSON."""
