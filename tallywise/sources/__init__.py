"""Readers for transcripts, status snapshots, price catalogs and test tables."""
