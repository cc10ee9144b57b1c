"""The registered queries: every operator over the given tables, with equivalent SQL."""

from checks.registry import all_oracles, all_queries  # noqa: F401
