"""Every registered query of the relational engine against the host database."""

from __future__ import annotations

import pytest

import basalt.plans  # noqa: F401
from basalt.registry import ORACLES, QUERIES

from .compare import rows_from, rows_of


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_every_kind_of_join_runs_over_whole_tables():
    kinds = ["inner", "left", "right", "full", "semi", "anti", "right_semi", "right_anti"]
    names = {f"join_tables_{on}_{kind}" for on in ("equi", "mixed", "theta") for kind in kinds}
    assert names <= set(QUERIES)
    assert not any("VALUES" in ORACLES[n] for n in names)
    assert not any("AND" in ORACLES[n] for n in names if "_equi_" in n)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, host, name):
    assert rows_of(QUERIES[name](spark, data)) == rows_from(host, ORACLES[name])
