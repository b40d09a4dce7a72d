"""Named queries over the test tables, each with the SQL that has to give the same rows."""

QUERIES, ORACLES = {}, {}


def register(name, build, sql=None):
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = sql


def query(name, sql=None):
    def wrap(build):
        register(name, build, sql)
        return build

    return wrap
