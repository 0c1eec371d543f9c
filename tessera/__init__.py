"""A PySpark-native engine for record linkage and training corpora. Names are loaded when they are asked
for, so that workers import no more than they run."""

from importlib import import_module

_WHERE = {
    "normalize": ".plans.normalize", "learn_token_map": ".plans.normalize", "kept_token_map": ".plans.normalize",
    "link": ".plans.linkage", "link_v3": ".plans.linkage", "rescore": ".plans.linkage", "candidates": ".plans.linkage", "PRESETS": ".plans.linkage",
    "retrieve": ".operators.blocks", "reverse_search": ".operators.blocks", "top_k": ".operators.tfidf", "pair_cosine": ".operators.tfidf",
    "pair_features": ".operators.features", "decide": ".operators.decide", "macro_f05": ".operators.metrics", "blocking_total": ".operators.metrics",
    "read_tsv": ".sources.tables", "read_source": ".sources.tables", "read_truth": ".sources.tables", "write_outputs": ".sources.outputs", "validate": ".sources.outputs",
    "link_stream": ".streaming.incremental",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module = import_module(_WHERE[name], __name__)
    return getattr(module, name)
