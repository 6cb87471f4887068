"""Readers of the text, XML and table formats that releases are built from, and writers."""
