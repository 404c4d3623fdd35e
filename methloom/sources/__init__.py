"""Readers and writers of the text, alignment and table formats."""
