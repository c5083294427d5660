"""All queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "media_jpeg",
    "chat_format",
    "language_hd",
    "decontaminate",
    "secret_scan",
    "piece_sampling",
    "jaccard_join",
    "substring_dedup",
    "html_extract",
    "pii_weak",
    "bottom_k",
    "source_divergence",
    "block_norms",
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"waybill.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
