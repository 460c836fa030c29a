"""Readers and writers for table sets, schema documents, DDL text, payloads and files."""
