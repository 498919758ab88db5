"""All registered queries and their reference SQL."""

from __future__ import annotations


def all_queries():
    from sightline.registry import base
    from sightline.registry import charts, findings, profiles, series, sources, texts  # noqa: F401

    return dict(base.QUERIES), dict(base.ORACLE)
