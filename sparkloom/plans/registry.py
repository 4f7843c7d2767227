"""Every query of the library's own operators, with the SQL that states its result."""

from __future__ import annotations

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under ``name``."""

    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    from sparkloom.plans import audit, retrieval, structure, upkeep  # noqa: F401  they register themselves


def queries() -> dict:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
