"""The queries over the reference's own operators, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from quirespark.plans import check_plans, fold_sql, page_plans, reading_plans, record_plans, stream_plans, unit_plans

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (page_plans, unit_plans, record_plans, stream_plans, check_plans, reading_plans):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
SQL |= fold_sql.SQL
