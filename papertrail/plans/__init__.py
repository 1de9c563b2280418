"""Runnable queries over the driver tables and their SQL twins."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every query module so that its queries register."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
