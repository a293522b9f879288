"""Input bridge and the query catalogue."""

import importlib
import pkgutil


def all_entries():
    """Every registered query (imports all ``queries_*`` modules)."""
    from millrace.plans import catalog

    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("queries_"):
            importlib.import_module(f"{__name__}.{module.name}")
    return catalog.ENTRIES
