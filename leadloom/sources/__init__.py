"""Readers: lead files, harvested pages, contact payloads, logs and responses."""
