"""Composed reports over cutting plans."""
