"""Readers of the JSON documents, uploads and glossary, and the versioned store."""
