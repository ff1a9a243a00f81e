"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from ..sources.shared import short_batches
from . import q_sampling, q_serve, q_sources, q_spans, q_text, q_threads

MODULES = (q_text, q_threads, q_sampling, q_spans, q_serve, q_sources)


def queries() -> dict:
    return {name: _texts(q[0]) for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: f"SELECT * REPLACE (week::VARCHAR AS week) FROM ({q[1]})" if len(q) > 2 else q[1] for m in MODULES for name, q in m.QUERIES.items() if q[1]}


def _texts(f):
    """f in a session with short Arrow batches, with dates as text, which every engine prints alike."""

    def query(spark, sf_dir):
        df = f(short_batches(spark), sf_dir)
        return df.withColumns({c: df[c].cast("string") for c, kind in df.dtypes if kind == "date"})

    return query
