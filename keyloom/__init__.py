"""Keysets, full text, graphs and standing rules over schemaless records, as plain Spark plans."""
