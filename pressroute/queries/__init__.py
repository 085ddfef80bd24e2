"""All registered queries, by section."""

from importlib import import_module
from pkgutil import iter_modules

from pressroute.queries.registry import ORACLE, QUERIES

for _module in sorted(m.name for m in iter_modules(__path__) if m.name.startswith("q")):
    import_module(f"{__name__}.{_module}")

__all__ = ["ORACLE", "QUERIES"]
