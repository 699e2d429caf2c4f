"""All registered queries by name."""

from __future__ import annotations

from tallyhouse.plans import enrichment, listings, reports, streams, workflow
from tallyhouse.plans.base import Registered

QUERIES: dict[str, Registered] = {
    **listings.QUERIES, **reports.QUERIES, **enrichment.QUERIES, **workflow.QUERIES, **streams.QUERIES,
}
