"""Hard-negative mining: integer score tiles by Strassen's recursion, top lists that merge.

Each component becomes ``floor(scale * x)``; a row's score is its integer inner
product with the anchor.  Higher scores come first, ties by smaller id.  An
anchor's *positives* are its first ``positives`` other rows of its label; for each,
its *negatives* are the first ``negatives`` rows of other labels whose score lies in
``[low / 100, high / 100]`` of the positive's.

1. *Blocks.* Rows are dealt into blocks by vector length, a group of labels
   (``GROUPS``, by hash) and a hash of the row's own number, so that neither a hot label
   nor a hot id fills one; a block is a few MB at most.  Anchors have blocks of their own.
2. *Tiles.* Each pair of an anchor block and a candidate block that can hold what is
   sought meets by an equi-join on both blocks' numbers: for positives blocks of one
   label group, for negatives all.  A task multiplies one tile after another:
   Strassen's seven half-size products, tiles padded with zeros to even halves, in
   64-bit integers.  Its sums wrap around alike, so every score that fits is exact.
3. *Positives.* A task keeps one list of the best a anchor, merges each tile's into it and
   hands on the lists; the last cut is a row number within the anchor, and Spark
   cuts before that shuffle too.
4. *Windows.* Anchors meet their positives' scores and go through the tiles again;
   each window keeps a list in the same way.

All anchors are compared with all rows, in blocks: the work is the product of the
two, but a block of the larger side serves a whole block of anchors.

Defined cases: rows with a null id, label or vector, or null or non-finite components
take no part; neither do rows whose squared integer length reaches 2**60 (their
scores may be no longs).  Zero vectors and negative scores count (no score lies in
the window of a negative positive).  Vectors are compared with those of their length
only.  Of rows that share an id each is a row of its own, and an anchor of its own
where ids are anchors (a list may then hold an id twice, ties by row number); repeated
rows likewise.  An anchor without positives has no result, a positive without
negatives neither; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, written

SCALE, POSITIVES, NEGATIVES, WINDOW = 256, 5, 3, (50, 95)
GROUPS = 16
BLOCK = 1 << 20  # components of the rows of a salt, all label groups together; a block holds no more, where one label holds all
TILES, MOST_TASKS = 16, 1 << 15  # tiles a task where there are many
_LEAF, _COLUMNS, _HELD = 32, 4096, 1 << 21  # smallest half that is halved again; columns multiplied at once; list entries held by a task
_NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = _LEAF) -> np.ndarray:
    """``a @ b`` of 64-bit integers, by seven products of halves; odd edges are padded with zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) < 2 * leaf:
        return a @ b
    a, b = (np.pad(x, [(0, s % 2) for s in x.shape]) for x in (a, b))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l], out[:i, l:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :l], out[i:, l:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


class Best:
    """For each of ``n`` owners the ``k`` first entries: greatest score, then smallest id, then smallest row.  Merges."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id, self.row = np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)

    def merge(self, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        """Take in entries, ``n x any``; ``_NONE`` marks no entry."""
        score, ids, row = (np.concatenate([x, y], 1) for x, y in ((self.score, score), (self.id, ids), (self.row, row)))
        order = np.lexsort((row, ids, ~score), axis=1)[:, : self.k]
        self.score, self.id, self.row = (np.take_along_axis(x, order, 1) for x in (score, ids, row))

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, score, id and row of all entries."""
        owner, place = np.nonzero(self.score != _NONE)
        return owner, self.score[owner, place], self.id[owner, place], self.row[owner, place]


def first_columns(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every row the ``k`` greatest, leftmost first among equals: scores and columns."""
    k = min(k, score.shape[1])
    if score.shape[1] > 8 * k:  # all that reach the k-th greatest, then in order
        edge = np.partition(score, score.shape[1] - k, 1)[:, -k][:, None]
        above, ties = score > edge, score == edge
        room = k - above.sum(1, keepdims=True)
        column = np.nonzero(above | (ties & (np.cumsum(ties, 1) <= room)))[1].reshape(len(score), k)
    else:
        column = np.broadcast_to(np.arange(score.shape[1]), score.shape)
    found = np.take_along_axis(score, column, 1)
    order = np.argsort(~found, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(found, order, 1), np.take_along_axis(column, order, 1)


class _Block:
    """Rows of one block in the order of their ids."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values(["id", "row"])
        self.id, self.row, self.label = pdf["id"].to_numpy(), pdf["row"].to_numpy(), pdf["label"].to_numpy(object)
        self.vec = np.stack(pdf["vec"].to_numpy()).astype(np.int64)
        self.windows = [np.asarray(w, np.int64) for w in pdf["windows"]] if "windows" in pdf else None

    def packed(self) -> dict:
        out = {"ids": self.id.tobytes(), "rows": self.row.tobytes(), "labels": self.label.tolist(), "vecs": self.vec.tobytes()}
        if self.windows is not None:
            out["windows"] = np.concatenate(self.windows).tobytes()
            out["counts"] = np.array([len(w) // 2 for w in self.windows], np.int64).tobytes()
        return out


_PACKED = "ids binary, rows binary, labels array<string>, vecs binary"


def _blocks(rows: DataFrame, salts: int, side: str, extra: str = "") -> DataFrame:
    """Rows packed a block a row: ``width, group, salt`` and the packed columns, all with ``side`` before their names."""
    names = [c.split()[0] for c in f"{_PACKED}{extra}".split(", ")]

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(("width", "group", "salt"), key)) | _Block(pdf).packed()])[["width", "group", "salt", *names]]

    keyed = rows.withColumn("salt", F.pmod(F.xxhash64(F.col("row"), F.lit(1)), F.lit(salts)).cast("int"))
    packed = keyed.groupBy("width", "group", "salt").applyInPandas(pack, f"width int, group int, salt int, {_PACKED}{extra}")
    return packed.select(*[F.col(c).alias(f"{side}_{c}") for c in packed.columns])


def _salts(df: DataFrame) -> int:
    """How many blocks a label group's rows are dealt into."""
    return int(df.agg(F.sum(F.greatest(F.col("width"), F.lit(1)))).first()[0] or 0) // BLOCK + 1


def _tiles(anchors: DataFrame, others: DataFrame, a_salts: int, c_salts: int, one_group: bool) -> DataFrame:
    """Pairs of blocks: an equi-join on the numbers of both, dealt by them."""
    count = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left, right = anchors.withColumn("c_salt_", count(c_salts)), others.withColumn("a_salt_", count(a_salts))
    keys = [("a_width", "c_width"), ("a_salt", "a_salt_"), ("c_salt_", "c_salt")]
    if one_group:
        keys.append(("a_group", "c_group"))
    else:
        left, right = left.withColumn("c_group_", count(GROUPS)), right.withColumn("a_group_", count(GROUPS))
        keys += [("a_group", "a_group_"), ("c_group_", "c_group")]
    tiles = a_salts * c_salts * GROUPS * (1 if one_group else GROUPS)
    n = max(int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(tiles // TILES, MOST_TASKS))
    left, right = left.repartition(n, *[k for k, _ in keys]), right.repartition(n, *[k for _, k in keys])
    return left.join(right.hint("shuffle_hash"), [F.col(x) == F.col(y) for x, y in keys])


def _lists(tiles: DataFrame, k: int, windowed: bool) -> DataFrame:
    """``owner`` (the anchor's row), ``anchor``, ``place`` (which of its windows), ``score, id, row``: the best of each task."""

    def best(batches):
        held: dict[bytes, tuple[_Tile, Best]] = {}
        size = 0
        for pdf in batches:
            for tile in pdf.itertuples(index=False):
                a = _Tile(tile, "a", windowed)
                name = tile.a_rows
                if name not in held:
                    held[name] = a, Best(len(a.owner), k)
                    size += len(a.owner) * k
                a, lists = held[name]
                if len(a.owner):
                    _judge(a, _Tile(tile, "c", False), lists)
                if size > _HELD:
                    yield from (_frame(*x) for x in held.values())
                    held, size = {}, 0
        yield from (_frame(*x) for x in held.values())

    return tiles.mapInPandas(best, "owner long, anchor long, place int, score long, id long, row long")


class _Tile:
    """One side of a tile.  ``owner``: of each wanted list the anchor's place; its scores lie in ``[low, high]``."""

    def __init__(self, tile, side: str, windowed: bool):
        get = lambda name: getattr(tile, f"{side}_{name}")
        self.id, self.row = (np.frombuffer(get(c), np.int64) for c in ("ids", "rows"))
        self.label, n = np.array(get("labels"), object), len(self.id)
        self.vec = np.frombuffer(get("vecs"), np.int64).reshape(n, get("width"))
        self.windowed = windowed
        self.owner, self.place = np.arange(n), np.zeros(n, np.int64)
        if windowed:
            counts = np.frombuffer(get("counts"), np.int64)
            self.owner = np.repeat(self.owner, counts)
            self.place = np.arange(len(self.owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            self.low, self.high = np.frombuffer(get("windows"), np.int64).reshape(-1, 2).T


def _judge(a: _Tile, c: _Tile, lists: Best) -> None:
    """Merge the tile's best into the lists."""
    code = pd.factorize(np.concatenate([a.label, c.label]))[0]
    mine, theirs = code[: len(a.id)], code[len(a.id) :]
    for lo in range(0, len(c.id), _COLUMNS):
        part = slice(lo, lo + _COLUMNS)
        same = mine[:, None] == theirs[None, part]
        ok = ~same if a.windowed else same & (a.row[:, None] != c.row[None, part])
        if not ok.any():
            continue
        score = np.where(ok, strassen(a.vec, np.ascontiguousarray(c.vec[part].T)), _NONE)
        if a.windowed:
            # a list after the other of an anchor, so that no more than one tile of scores is held
            for place in range(int(a.place.max()) + 1):
                on = np.flatnonzero(a.place == place)
                s = score[a.owner[on]]
                within = (s >= a.low[on, None]) & (s <= a.high[on, None])
                hit = np.flatnonzero(within.any(1))
                if not len(hit):
                    continue
                found, column = first_columns(np.where(within[hit], s[hit], _NONE), lists.k)
                whole_s, whole_c = np.full((len(lists.score), found.shape[1]), _NONE), np.zeros((len(lists.score), found.shape[1]), np.int64)
                whole_s[on[hit]], whole_c[on[hit]] = found, column
                lists.merge(whole_s, c.id[part][whole_c], c.row[part][whole_c])
        else:
            found, column = first_columns(score, lists.k)
            lists.merge(found, c.id[part][column], c.row[part][column])


def _frame(a: _Tile, lists: Best) -> pd.DataFrame:
    at, score, ids, row = lists.entries()
    owner = a.owner[at]
    return pd.DataFrame({"owner": a.row[owner], "anchor": a.id[owner], "place": a.place[at].astype(np.int32), "score": score, "id": ids, "row": row})


def _cut(lists: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each list over all tasks, with ``rank`` from 1."""
    order = Window.partitionBy("owner", "place").orderBy(F.desc("score"), "id", "row")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: float = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` marks the rows that are anchors; ``label`` is a column or an expression.
    """
    spark, by = rows.sparkSession, F.lit(float(scale))
    label = F.col(label) if isinstance(label, str) else label
    given = rows.select(F.col(vec_id).cast("long").alias("id"), label.cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * by) >= 2.0**30))
    usable = given.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~bad, F.lit(False)))
    usable = usable.withColumn("vec", F.transform("vec", lambda x: F.floor(x * by).cast("long")))
    squared = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    usable = usable.where(squared < 2.0**60).withColumns({"width": F.size("vec"), "group": F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int")})
    own = written(usable.withColumn("row", F.monotonically_increasing_id()), "rows")
    asked = own.where("anchor").drop("anchor")
    a_salts, c_salts = _salts(asked), _salts(own)
    low, high = window
    part = lambda p, share: p["score"].cast("decimal(38,0)") * share / 100
    bounds = lambda p: F.array(F.ceil(part(p, low)).cast("long"), F.floor(part(p, high)).cast("long"))  # low * p <= 100 * score <= high * p
    with batches_of(spark, 4):
        blocks = written(_blocks(own.drop("anchor"), c_salts, "c"), "candidates")
        near = _lists(_tiles(_blocks(asked, a_salts, "a"), blocks, a_salts, c_salts, True), positives, False)
        near = written(_cut(near, positives).select("owner", F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("place")), "positives")
        sought = near.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("place", F.col("positive_score").alias("score")))).alias("found"))  # at most `positives` a row
        sought = asked.join(sought, asked["row"] == sought["owner"]).withColumn("windows", F.flatten(F.transform("found", bounds))).drop("owner", "found")
        hard = written(_lists(_tiles(_blocks(sought, a_salts, "a", ", windows binary, counts binary"), blocks, a_salts, c_salts, False), negatives, True), "negatives")
    hard = _cut(hard, negatives).select("owner", "place", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hard.join(near, ["owner", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
