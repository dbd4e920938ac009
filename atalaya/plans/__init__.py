"""Ready-made plans: the monitoring run and the named queries."""


def _load():
    from atalaya.plans import captures, registry, rows, state, stored, streams  # noqa: F401

    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_checks():
    return dict(_load().CHECKS)
