"""Operators for large text corpora and pairwise matches. Nothing else imports this package."""
