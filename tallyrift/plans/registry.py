"""All the reference's queries and their oracles; each module adds its own."""

from tallyrift.plans import boards, lookups, maps, pages, profiles, publishing  # noqa: F401
from tallyrift.plans.queries import ORACLES, QUERIES, rollup_region_weighted

__all__ = ["ORACLES", "QUERIES", "rollup_region_weighted"]
