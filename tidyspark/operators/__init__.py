"""Relational operators: canonicalisation, deduplication, enrichment and verification."""
