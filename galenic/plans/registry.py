"""Name -> query and name -> SQL of the catalogue's operators."""

from galenic.plans import advanced, serving  # noqa: F401  register their queries
from galenic.plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
