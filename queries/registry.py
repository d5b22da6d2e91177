"""Registry of queries with the SQL that must give the same rows."""

QUERIES = {}
ORACLE = {}


def query(name, sql=None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function
    return add
