"""All registered queries; importing the catalog modules fills the registry."""

from riskloom.plans import closed_forms, models_catalog, sources_catalog, tables_catalog, tests_catalog  # noqa: F401
from riskloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
