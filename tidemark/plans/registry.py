"""Every registered query and, where SQL can say it, the SQL it must agree with."""

from tidemark.plans import avoid, events, forecasts, market, reports, rules  # noqa: F401  all add to market's tables

QUERIES: dict = market.QUERIES
ORACLE_SQL: dict = market.ORACLE_SQL
