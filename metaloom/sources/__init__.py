"""Readers: files and text cells to flat records, vocabularies, gazetteers, sinks."""
