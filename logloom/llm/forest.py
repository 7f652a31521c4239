"""Union-find over numpy arrays, and the blocks into which a large group splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def united(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j, pair by pair; every entry of parent stays a root's number, the least of its tree."""
    while len(i):
        ri, rj = parent[i], parent[j]
        apart = ri != rj
        if not apart.any():
            return
        i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
        np.minimum.at(parent, np.maximum(ri, rj), np.minimum(ri, rj))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def block_tasks(blocks: Column, own: Column) -> Column:
    """The tasks (i, j) with i <= j that a row of block ``own`` takes part in, so that any two blocks of a group meet once."""
    return F.transform(F.sequence(F.lit(0), blocks.cast("int") - 1), lambda o: F.struct(F.least(own, o).alias("bi"), F.greatest(own, o).alias("bj")))
