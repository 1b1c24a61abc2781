"""Readers and writers of sequence files; paths are whatever Spark can read."""
