"""Registered queries that draw or permute: over all bars, and as often as the operator does by default."""

from __future__ import annotations

import inspect
import os

import pytest

from tidemill.operators import backtest as bt
from tidemill.operators import nulls
from tidemill.plans import queries
from tidemill.plans import workflows as wf

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_permutation_covers_all_bars(spark):
    whole = {x.symbol: x.score for x in bt.metrics(queries.curve(spark, SF), queries.KEYS, queries.WEEKLY).collect()}
    got = {x.symbol: x.observed for x in queries.permutation(spark, SF).collect()}
    assert got == pytest.approx(whole) and len(got) == 5


def test_bootstrap_draws_as_often_as_by_default(spark):
    often = inspect.signature(nulls.bootstrap).parameters["samples"].default
    got = queries.registered()["bootstrap_ci"](spark, SF).collect()
    assert {x.n_bootstrap for x in got} == {often} == {inspect.signature(wf.research_protocol).parameters["samples"].default}
    assert queries.SAMPLES == often
