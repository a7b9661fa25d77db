"""All queries of the library, and the SQL of those that SQL can express."""

from . import admin, choices, coding, extras, learning, streams, texts  # noqa: F401

QUERIES = coding.QUERIES
SQL = coding.SQL
