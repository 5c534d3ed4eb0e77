"""Composed jobs and the registered queries over the driver tables."""

from __future__ import annotations


def _load():
    from sonaria.plans import (  # noqa: F401
        dataset_queries,
        job_queries,
        matching_queries,
        session_queries,
        signal_queries,
        streaming_queries,
        text_queries,
    )
    from sonaria.plans.registered import QUERIES, STATEMENTS

    return QUERIES, STATEMENTS


def all_queries():
    return dict(_load()[0])


def all_statements():
    return dict(_load()[1])
