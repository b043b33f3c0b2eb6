"""Queries of this package and their SQL."""

from strataline.queries import collect

MODULES = ("tokens", "packing", "cooccurrence", "neighbours", "handwritten", "spans")


def llm() -> tuple[dict, dict]:
    return collect("strataline.llm", MODULES)
