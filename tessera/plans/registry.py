"""All queries of the library by name, and their SQL oracles."""

from tessera.plans import answers, assessment, changes, content, content_checks, dashboards, decisions, evidence, layout, promotion, relational, reports, requests, scalars, trees  # noqa: F401
from tessera.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
