"""Readers and writers: record files, pages, sitemaps, checkpoints, catalogs."""
