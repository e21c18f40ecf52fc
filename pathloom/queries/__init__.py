"""Named queries over the test tables, with the SQL that checks them."""

from pathloom.queries import files, records

MODULES = [records, files]


def all_queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def all_sql():
    return {k: v for m in MODULES for k, v in m.SQL.items()}
