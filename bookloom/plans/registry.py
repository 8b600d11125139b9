"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from bookloom.plans import advert_queries, book_queries, edit_queries, file_queries, format_queries, review_queries, structure_queries, text_queries, title_queries

_MODULES = (text_queries, advert_queries, edit_queries, book_queries, format_queries, file_queries, title_queries, review_queries, structure_queries)


def queries() -> dict:
    return {name: pair[0] for module in _MODULES for name, pair in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: pair[1] for module in _MODULES for name, pair in module.QUERIES.items() if pair[1]}


flagship = text_queries.flagship
