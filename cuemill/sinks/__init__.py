"""Rendering tables to documents and writing them."""
