"""Registered queries over the test tables, each with the SQL its result must equal."""

from workload import catalog_q, conformance_q, html_q, lifecycle_q, lookups_q, releases_q, search_q, streaming_q  # noqa: F401
from workload.base import ORACLES, QUERIES  # noqa: F401
