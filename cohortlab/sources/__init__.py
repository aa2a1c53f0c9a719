"""Readers and writers: metadata tables, id lists, result files, volumes."""
