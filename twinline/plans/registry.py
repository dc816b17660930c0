"""All queries of the core and their SQL."""

from twinline.plans import io_queries, queries, skew_queries

QUERIES = {**queries.QUERIES, **skew_queries.QUERIES, **io_queries.QUERIES}
SQL = {**queries.SQL, **skew_queries.SQL, **io_queries.SQL}
