"""Query plans bound to the driver's tables, each with its DuckDB oracle SQL."""

from shipfold.plans.registry import ORACLE, QUERIES, register

# Importing the modules fills the registry.
from shipfold.plans import queries_list as _queries_list  # noqa: F401,E402
from shipfold.plans import queries_fold as _queries_fold  # noqa: F401,E402
from shipfold.plans import queries_sources as _queries_sources  # noqa: F401,E402
from shipfold.plans import queries_milestone as _queries_milestone  # noqa: F401,E402
from shipfold.plans import queries_tables as _queries_tables  # noqa: F401,E402
from shipfold.plans import queries_selections as _queries_selections  # noqa: F401,E402

__all__ = ["ORACLE", "QUERIES", "register"]
