"""Registered queries with their SQL."""

from kindred.jobs import articles, corpus, parsers, posts, similarity, streams, texts
from kindred.jobs.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "articles", "corpus", "parsers", "posts", "similarity", "streams", "texts"]
