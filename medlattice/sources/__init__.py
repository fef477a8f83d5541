"""Readers and writers of the warehouse and of the trial files."""
