"""Buckets of any size compared in blocks of bounded size; a block pair reports a forest, not all pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(members: DataFrame, payload: list[str], pairs: Callable, ddl: str, block: int) -> DataFrame:
    """What ``pairs`` finds within buckets of ``members`` (key, n, doc_id, payload...), n being the bucket's size.

    A bucket of n members is dealt to ceil(n / block) blocks by a hash of the
    member.  ``pairs`` gets rows (left, right) of a block pair, right null for a
    block with itself, as Arrow batches.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = members.select(
        "key", blocks.alias("blocks"), F.pmod(F.xxhash64("doc_id", "key"), blocks).cast("int").alias("block"), F.struct("doc_id", *payload).alias("x")
    ).select(
        "key",
        "x",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("blocks") - 1),
                lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"), (F.col("block") <= j).alias("left"), (F.col("block") >= j).alias("right")),
            )
        ).alias("at"),
    )
    side = lambda which: F.collect_list(F.when(F.col(f"at.{which}"), F.col("x")))
    grouped = dealt.groupBy("key", F.col("at.i").alias("i"), F.col("at.j").alias("j")).agg(side("left").alias("left"), side("right").alias("right"))
    return grouped.select("left", F.when(F.col("i") != F.col("j"), F.col("right")).alias("right")).mapInArrow(pairs, ddl)


class Forest:
    """Union-find over n nodes, kept as labels: an edge is only told if it joins two trees."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, node: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` whose edge to ``node`` joins another tree, one for each tree."""
        labels, at = np.unique(self.label[others], return_index=True)
        new = labels != self.label[node]
        if new.any():
            self.label[np.isin(self.label, labels)] = self.label[node]
        return others[at[new]]
