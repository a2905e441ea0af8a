"""Named queries and the SQL that an independent engine runs for comparison."""

from collections.abc import Callable

from ..sources.fixtures import oracle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, derived: bool = True):
    """Register a query under its function's name; ``sql`` runs over the derived tables, or the raw ones if not ``derived``."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql) if derived else sql
        return f

    return register


def sql_in(pattern: str) -> str:
    from ..functions.patterns import combos

    return "(" + ", ".join(f"'{c}'" for c in combos(pattern)) + ")"
