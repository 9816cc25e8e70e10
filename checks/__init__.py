"""Queries over the given tables, one or more per operator, with SQL that gives the same rows."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def all_queries():
    from checks import registry
    from checks import q_basics, q_blocks, q_fields, q_files, q_requests, q_vision  # noqa: F401

    return dict(registry.QUERIES), dict(registry.ORACLES)
