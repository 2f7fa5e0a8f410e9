"""Derived corpora, the query catalog and its SQL counterparts."""
