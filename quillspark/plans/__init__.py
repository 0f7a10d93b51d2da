"""Importing this package fills the registry with every query of the library itself."""

from __future__ import annotations

from quillspark.operators import OPERATORS, Operator
from quillspark.operators.base import DUCK
from quillspark.registry import REGISTRY, query
from quillspark.sources.views import subquery, view


def _register(op: Operator) -> None:
    sql = op.sql(DUCK, **{i: subquery(i) for i in op.inputs}) if op.checked else None
    query(op.name, sql)(lambda spark, sf_dir: op(**{i: view(spark, sf_dir, i) for i in op.inputs}))


from quillspark.plans import readings  # noqa: E402, F401  before its operators are registered as they stand

for _op in OPERATORS.values():
    if _op.name not in REGISTRY:
        _register(_op)

from quillspark.plans import grouped, lexicons, streams  # noqa: E402, F401
