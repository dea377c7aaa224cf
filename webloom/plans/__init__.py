"""Query plans over the standard tables: ``QUERIES`` by name, and ``ORACLE_SQL`` for those SQL can express."""

from . import crawling, text, web

QUERIES: dict = {**web.QUERIES, **text.QUERIES, **crawling.QUERIES}
ORACLE_SQL: dict = {**web.ORACLE_SQL, **text.ORACLE_SQL, **crawling.ORACLE_SQL}
