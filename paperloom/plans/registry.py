"""Every registered query outside the llm package, with its SQL oracle where one exists."""

from __future__ import annotations

from functools import wraps

from paperloom.plans import answers, curation, evaluation, incremental, papers, questions, records, search, streams

from paperloom.session import ship_package

MODULES = (search, curation, streams, papers, questions, answers, evaluation, records, incremental)


def _shipped(f):
    @wraps(f)
    def query(spark, sf_dir):
        ship_package(spark)
        return f(spark, sf_dir)

    return query


QUERIES = {name: _shipped(f) for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
