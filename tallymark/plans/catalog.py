"""Registered queries of the receipt operators and their SQL."""

from __future__ import annotations

from tallymark.plans import bursts, evidence, extra, linkage, repeats, sinks, streams

QUERIES: dict = linkage.QUERIES | evidence.QUERIES | bursts.QUERIES | streams.QUERIES | extra.QUERIES | repeats.QUERIES | sinks.QUERIES
ORACLE_SQL: dict = linkage.ORACLE_SQL | evidence.ORACLE_SQL | bursts.ORACLE_SQL | streams.ORACLE_SQL | extra.ORACLE_SQL | repeats.ORACLE_SQL | sinks.ORACLE_SQL
