"""ledgerlens: sales analytics as Spark DataFrame plans.

Every operator takes a DataFrame plus a :class:`~ledgerlens.roles.Roles`
mapping (business role -> column name) and returns a DataFrame.  Nothing is
collected to the driver except a handful of plan-deciding scalars.
"""

from ledgerlens.roles import Roles, SALES_FACT_ROLES

__all__ = ["Roles", "SALES_FACT_ROLES"]
