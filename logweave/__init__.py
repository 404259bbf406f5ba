"""logweave: log-parser lineage and log-event processing on Spark DataFrames."""

from importlib import import_module

#: Public names and the modules that have them, which are imported when a name is first used.
_EXPORTS = {
    "ParserLineage": "logweave.operators.query", "QueryResult": "logweave.operators.model", "Lineage": "logweave.operators.model", "Source": "logweave.operators.model",
    "Anchor": "logweave.operators.model", "Diagnostic": "logweave.operators.model", "STATUSES": "logweave.operators.model", "LIVE": "logweave.operators.model",
    "analyze_corpus": "logweave.operators.corpus", "read_parsers": "logweave.operators.corpus", "Runtime": "logweave.plans.runtime", "run_parser": "logweave.plans.runtime", "parse": "logweave.plans.syntax",
}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(name)
    return getattr(import_module(_EXPORTS[name]), name)
