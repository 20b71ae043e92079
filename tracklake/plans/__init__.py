"""Registered queries: operators applied to the test tables, with the SQL that gives the same rows."""

from tracklake.plans import acceptance_queries as acceptance_queries
from tracklake.plans import calibration_queries as calibration_queries
from tracklake.plans import composite_queries as composite_queries
from tracklake.plans import long_queries as long_queries
from tracklake.plans import matching_queries as matching_queries
from tracklake.plans import planning_queries as planning_queries
from tracklake.plans import report_queries as report_queries
from tracklake.plans import scene_queries as scene_queries
from tracklake.plans import space_queries as space_queries
from tracklake.plans import stream_queries as stream_queries
from tracklake.plans import time_queries as time_queries
from tracklake.plans import trajectory_queries as trajectory_queries
from tracklake.plans.registry import ORACLE_SQL as ORACLE_SQL
from tracklake.plans.registry import QUERIES as QUERIES
