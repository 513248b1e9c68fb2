"""Freshness: snapshot diffs and incremental maintenance of facts."""
