"""Names that look numbered already, and annotation that leaves positions out."""
import warnings

import pytest

from labelmx.operators import names as N
from labelmx.operators import update as U
from labelmx.plans.local import small_table

from helpers import names


def test_warning_of_numbered_names(make):
    lm = make(None, ["lamp", "lamp-1", "lamp", "rug", "lamp-2x", "rug"], ["v"])
    with pytest.warns(UserWarning, match="lamp-1"):
        out = N.make_names_unique(lm, "obs")
    assert names(out, "obs") == ["lamp", "lamp-1", "lamp-2", "rug", "lamp-2x", "rug-1"]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        # a numbered look matters only behind a name that repeats
        quiet = N.make_names_unique(make(None, ["lamp", "lamp-1", "rug", "rug"], ["v"]), "obs")
    assert names(quiet, "obs") == ["lamp", "lamp-1", "rug", "rug-1"]


def test_annotation_gives_every_position_once(spark, make):
    lm = make(None, ["a", "b", "c"], ["v"])
    rows = lambda *r: small_table(spark, r, "pos bigint, name string, w bigint")
    out = U.replace_annotation(lm, "obs", rows((2, "z", 3), (0, "x", 1), (1, "y", 2)))
    assert names(out, "obs") == ["x", "y", "z"]
    for bad in (rows((0, "x", 1), (0, "y", 2), (2, "z", 3)), rows((0, "x", 1), (1, "y", 2), (3, "z", 3)), rows((0, "x", 1))):
        with pytest.raises(ValueError):
            U.replace_annotation(lm, "obs", bad)
