"""All corpus queries and their SQL, for the entry module."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "byte_pairs",
    "byte_repeats",
    "collocations",
    "fm_index",
    "hilbert_sharding",
    "line_crf",
    "line_runs",
    "merkle_manifest",
    "pfair_mixing",
    "quality_rules",
    "simhash",
    "tag_paths",
    "word_repeats",
)


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"fieldloom.llm.{module}"), name)
    return out


QUERIES = _merged("QUERIES")
ORACLE_SQL = _merged("ORACLE_SQL")
