"""Connected components of a link table by randomised contraction.

Each round every node moves to the member of its closed neighbourhood that a fresh hash order
puts first, and the links are renamed and made distinct; a constant share of the nodes vanishes
per round, so the number of rounds grows with the logarithm of the number of nodes, on chains
too. Rounds are small stored tables in the shared folder; nothing but the number of remaining
links reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcurve.llm.common import drop_stored, store


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; nodes of one component share a root.

    ``links`` holds two bigint columns; order, repeats, self links and nulls do not matter
    (a row with a null is no link). A node that only links to itself is its own root.
    """
    rows = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    pairs = store(rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    moves: list[DataFrame] = []
    while pairs.count():
        seed = len(moves)
        both = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("r"), F.col(c).alias("v"))
        move = store(
            both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("near"))
            .select("node", F.least(F.struct(F.xxhash64("node", F.lit(seed)).alias("r"), F.col("node").alias("v")), "near")["v"].alias("root")),
            "moves",
        )
        moves.append(move)
        to = lambda c: move.select(F.col("node").alias(c), F.col("root").alias(f"{c}_to"))
        renamed = pairs.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to")
        after = store(
            renamed.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "links"
        )
        drop_stored(pairs)
        pairs = after
    spark = links.sparkSession
    if not moves:
        return spark.createDataFrame([], "node bigint, root bigint")
    final = moves[-1]
    for move in reversed(moves[:-1]):
        later = final.select(F.col("node").alias("root"), F.col("root").alias("later"))
        final = move.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    out = store(final, "components")
    for table in [*moves, pairs]:
        drop_stored(table)
    return out
