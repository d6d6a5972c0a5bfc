"""Readers of export files and writers of the engine's tables."""
