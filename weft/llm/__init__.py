"""Training-data operators. Nothing else in the library imports this package.

``queries()`` maps each query name to ``(spark, sf_dir) -> DataFrame``; ``oracle_sql()`` holds
DuckDB SQL for those that SQL can express.
"""

from importlib import import_module

#: Modules that hold one operator each, in the order of the operator list.
MODULES = ("bpe", "quality", "tokenfile", "pii", "langid", "linededup", "jaccard", "packing", "ann", "htmltext")


def _collect(name):
    found = {}
    for module in MODULES:
        found.update(getattr(import_module(f"{__name__}.{module}"), name, {}))
    return found


def queries():
    return _collect("QUERIES")


def oracle_sql():
    return _collect("ORACLE_SQL")
