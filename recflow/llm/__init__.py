"""Operators that prepare large text and record collections for model training.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()`` are
picked up by the repository's entry module when the subpackage is present.
"""

from __future__ import annotations


def queries() -> dict:
    from .queries import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
