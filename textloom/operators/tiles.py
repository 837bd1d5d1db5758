"""Every query against every row, in tiles of blocks: each task sends only its best."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024  # rows of a block, about


def _blocks(rows: DataFrame, side: str, n: int) -> DataFrame:
    """Rows packed into ``n`` blocks, dealt by the row's own number, so that repeated rows spread."""
    at = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    packed = rows.select(at.alias(f"{side}_block"), F.struct(*rows.columns).alias("row")).groupBy(f"{side}_block").agg(F.collect_list("row").alias(f"{side}_rows"))
    return packed.withColumn(f"{side}_rows", F.struct(*[F.col(f"{side}_rows.{c}").alias(c) for c in rows.columns]))


def tiled(asks: DataFrame, rows: DataFrame, best: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, asked: int, stored: int) -> DataFrame:
    """What ``best`` gives for each pair of blocks; ``asked`` and ``stored`` say how many rows there are.

    The join is by the numbers of both blocks, so each tile is a key of its own, and a block of
    the one side is read once for a whole block of the other.
    """
    n, m = -(-asked // BLOCK) or 1, -(-stored // BLOCK) or 1
    left = _blocks(asks, "q", n).withColumn("v_at", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = _blocks(rows, "v", m).withColumn("q_at", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n * m // 16, 1 << 15))
    left, right = left.repartition(tasks, "q_block", "v_at"), right.repartition(tasks, "q_at", "v_block")
    tiles = left.join(right.hint("shuffle_hash"), (F.col("q_block") == F.col("q_at")) & (F.col("v_at") == F.col("v_block"))).select("q_rows", "v_rows")

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q, v in zip(pdf["q_rows"], pdf["v_rows"]):
                yield best(_frame(q), _frame(v))

    return tiles.mapInPandas(scored, schema)


def _frame(block) -> pd.DataFrame:
    return pd.DataFrame({c: list(block[c]) for c in (block if isinstance(block, dict) else block.asDict())})
