"""Readers, sinks and the mapping of the sample tables to the sales domain."""
