"""Readers and writers of dataset formats."""
