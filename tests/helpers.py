"""What several test modules use to read results."""

import math


def grid(lm, m=None):
    """Dense nested lists of a matrix, in axis order; NaN shows as None."""
    m = m or lm.X
    rows = m.cells.collect()
    cells = {(r.obs_key, r.var_key): r.value for r in rows}
    assert len(cells) == len(rows)
    obs = [r.key for r in lm.obs.select("key", "ord").sort("ord").collect()]
    var = [r.key for r in lm.var.select("key", "ord").sort("ord").collect()]
    assert all(o in obs and v in var for o, v in cells)
    show = lambda v: None if v is None or math.isnan(v) else v
    return [[show(cells.get((o, v), m.absent)) for v in var] for o in obs]


def names(lm, axis):
    return [r.name for r in lm.axis(axis).orderBy("ord").collect()]


def column(lm, axis, col):
    return [r[col] for r in lm.axis(axis).orderBy("ord").collect()]
