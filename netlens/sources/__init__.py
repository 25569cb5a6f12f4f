"""Readers and writers: dissector exports, packet tables, binary captures, documents."""
