"""Queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from importlib import import_module

MODULES = ("decontamination", "url_filters", "sharding", "line_dedup", "embedding_dedup", "toxicity", "quality", "pieces", "minhash_dedup", "suffix_dedup")


#: imported with this module, so that whoever imports it learns at once whether they can be
_MODULES = [import_module(f"quietcount.llm.{name}") for name in MODULES]


def queries() -> dict:
    out = {}
    for module in _MODULES:
        out |= {k: v for k, v in vars(module).items() if k.startswith("op") and k[2:3].isdigit()}
    return dict(sorted(out.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    out = {}
    for module in _MODULES:
        out |= module.SQL
    return out
