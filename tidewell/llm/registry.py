"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, line_dedup, media, minhash_dedup, packing, quality_rules, substring_dedup, url_filters, warc

_MODULES = [bpe, chat, line_dedup, media, minhash_dedup, packing, quality_rules, substring_dedup, url_filters, warc]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for m in _MODULES if hasattr(m, "SQL") for name in vars(m) if name.startswith("op")}
