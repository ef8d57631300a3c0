"""Memlake: DataFrame operators over conversation archives, retrieval logs and text corpora."""
