"""All registered queries of the library proper."""

from __future__ import annotations

from codequarry.plans import general, reference

QUERIES = {**general.QUERIES, **reference.QUERIES}
ORACLE = {**general.ORACLE, **reference.ORACLE}
