"""Readers, writers, generators and fixed tables."""
