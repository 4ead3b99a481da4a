"""Operators for large text corpora: near-duplicates, quality, licences,
personal data, mixing, token files and packing. See ``queries.py`` for the
registered queries."""
