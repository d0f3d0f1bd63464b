"""Relational, statistical, text, retrieval and evaluation operators."""
