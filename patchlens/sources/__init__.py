"""Readers and writers, all with explicit schemas."""
