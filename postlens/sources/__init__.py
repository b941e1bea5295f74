"""Readers and writers: the posts table, CSV reports and message topics."""
