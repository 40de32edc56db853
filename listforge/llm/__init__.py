"""Operators a training-data pipeline needs: scoring, counting, matching, de-duplication and mixing of documents."""
