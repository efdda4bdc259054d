"""Test-impact analysis on Spark."""

from __future__ import annotations

#: What users of the package need, by the module that has it; workers that read texts import none of the rest.
_API = {
    "Config": "config", "parse_config": "config", "load_config": "config", "Pattern": "extract.patterns", "Bind": "extract.patterns", "graph": "extract.build", "discovered": "sources.tree",
    "derive": "operators.traverse", "dependencies": "operators.traverse", "tests_from_sources": "operators.lookup", "sources_from_tests": "operators.lookup",
}
__all__ = list(_API)


def __getattr__(name: str):
    if name not in _API:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f".{_API[name]}", __name__), name)
