"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import importlib

#: query name -> module that has a function of that name (spark, sf_dir)
QUERIES = {
    "op4_token_counts": "edit_counts",
    "op10_chat_format": "chat",
    "op9_decontaminate": "decontaminate",
    "op2_near_copies": "near_copies",
    "op2_near_links": "near_copies",
    "op6_media": "media",
    "op1_license_scan": "licenses",
    "op3_url_filter": "urls",
    "op5_language_id": "language",
    "op7_token_files": "token_files",
    "op8_packing": "packing",
    "op11_spelling": "spelling",
    "op12_shards": "sharding",
    "op13_collocations": "collocations",
}


def query(name: str):
    return getattr(importlib.import_module(f"{__package__}.{QUERIES[name]}"), name)


def queries() -> dict:
    return {name: query(name) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return dict(sql.ORACLES)
