"""Readers: delimited text of unknown layout, zip archives, HTML catalog pages."""
