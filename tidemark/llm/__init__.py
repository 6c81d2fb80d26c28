"""Tidemark llm."""
