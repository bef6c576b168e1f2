"""Readers that turn files and ordinary tables into the block/ballot tables, and sinks."""
