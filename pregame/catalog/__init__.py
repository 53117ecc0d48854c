"""Named queries over the test tables, each with a SQL twin where SQL can express it."""

import importlib

MODULES = ["windows", "games", "scoring", "learning", "texts"]


def load():
    for name in MODULES:
        importlib.import_module(f"pregame.catalog.{name}")
    from pregame.catalog.base import QUERIES, SQL

    return QUERIES, SQL
