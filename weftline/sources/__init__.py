"""Readers and canonical projections."""
