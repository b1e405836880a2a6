"""Query definitions. Importing a ``queries_*`` module registers its queries."""

import importlib
import pkgutil

from .registry import QUERIES


def all_queries():
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        if m.startswith("queries_"):
            importlib.import_module(f"{__name__}.{m}")
    return QUERIES
