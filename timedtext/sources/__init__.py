"""Readers for comment files, site payloads and control documents."""
