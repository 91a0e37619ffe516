"""Readers and writers of tables, files and topics."""
