"""Embedding near-dedup by NN-descent within a label.

1. Equal vectors of a label form a class; one member stands for it.
2. A first neighbour graph comes from random hyperplane buckets, as many as the
   label's vectors need, large ones split at random; each vector keeps its ``k``
   nearest found of at least ``explore``.
3. Descent rounds are local joins: the lists of ``k`` both ways of a vector bring its
   neighbours together once, and pairs of them that haven't met there are compared
   for those whose list is not saturated; the best ``k`` stay, until next to no
   list changes.
4. A list is saturated if all its members link.  Such lists are enlarged to the
   whole linked component: its members are compared in blocks, and only counts
   of links leave a task.
5. An audit compares some vectors (their number grows with the table, and until
   they hold ``AUDIT_LINKS`` links or are ``AUDIT_MOST``) with all vectors; below
   ``AUDIT_RECALL`` more trees and rounds follow, and after ``MOST_TREES`` the
   labels that fail are compared exactly, block by block.  The last audit's
   recall is part of the result.

Links are pairs of cosine of at least ``threshold``, in double precision.

Defined cases: vectors that are null, zero, or hold null or non-finite
components, and vectors without label or ``vec_id``, link with nothing; labels of
any type are equal if they are equal as text; vectors of different length never
link; every row comes back once, and rows that share a ``vec_id`` count as
vectors of their own; columns are read by the names given and no others, so none can
clash; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written
from .components import components
from .vectors import stacked, unit, usable

THRESHOLD, EXPLORE, K = 0.93, 0.6, 32
TREES, BUCKET, BLOCK, STRIP = 6, 128, 4096, 512
AUDIT, AUDIT_LINKS, AUDIT_MOST, AUDIT_RECALL, AUDIT_BYTES = 200, 1000, 65536, 0.995, 64 << 20
MOST_TREES, STILL, EXACT_BLOCK = 48, 0.001, 1024


def _bits(n: int) -> int:
    """Hyperplanes that split ``n`` vectors of a label into buckets of about ``BUCKET``."""
    return max(0, math.ceil(math.log2(max(n, 1) / BUCKET)))


def _top(ids: np.ndarray, s: np.ndarray, others: np.ndarray, explore: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each row of ``s`` that reach ``explore``: row, other and cosine."""
    kk = min(k, s.shape[1])
    top = np.argpartition(-s, kk - 1, axis=1)[:, :kk]
    a, b, sim = np.repeat(ids, kk), others[top].ravel(), np.take_along_axis(s, top, 1).ravel()
    near = sim >= explore
    return a[near], b[near], sim[near]


def _nearest(ids: np.ndarray, s: np.ndarray, others: np.ndarray, explore: float, k: int) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("a", "b", "sim"), _top(ids, s, others, explore, k))))


def _graph(classes: DataFrame, seeds: range, explore: float, k: int) -> DataFrame:
    """``a, b, sim``: nearest found in the buckets of some random trees."""
    classes = classes.withColumn("label", F.col("label").cast("string"))
    sizes = classes.groupBy("label", F.size("vec").alias("size")).agg(F.count("*").alias("n_label"))

    def place(batches):
        for pdf in batches:
            for (size, bits), part in pdf.groupby(["size", pdf["n_label"].map(_bits)]):
                x = unit(stacked(part["vec"]))
                for tree in seeds:
                    planes = np.random.default_rng([tree, size]).normal(size=(size, bits))
                    sig = ((x @ planes > 0) * (1 << np.arange(bits))).sum(1) if bits else np.zeros(len(x), np.int64)
                    yield pd.DataFrame({"id": part["id"], "label": part["label"], "size": size, "tree": tree, "sig": sig.astype(np.int64), "vec": part["vec"]})

    rows = classes.select("id", "label", "vec", F.size("vec").alias("size")).join(sizes, ["label", "size"]).mapInPandas(place, "id long, label string, size int, tree int, sig long, vec array<double>")
    key = ["label", "size", "tree", "sig"]
    # Split buckets at random into parts of about BUCKET * 2 rows; counts are summed before they are joined.
    counts = rows.groupBy(*key).agg(F.count("*").alias("n_bucket")).where(F.col("n_bucket") > BUCKET * 4)
    rows = rows.join(counts, key, "left").withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.coalesce(F.ceil(F.col("n_bucket") / (BUCKET * 2)), F.lit(1))))

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = pdf["id"].to_numpy(), unit(stacked(pdf["vec"]))
        s = x @ x.T
        np.fill_diagonal(s, -2)
        return _nearest(ids, s, ids, explore, k)

    return rows.groupBy(*key, "part").applyInPandas(nearest, "a long, b long, sim double")


def _best(edges: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return edges.groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def _local(members: DataFrame, explore: float, k: int) -> DataFrame:
    """``a, b, sim``: the nearest of each member that ``asks`` among the others of its ``centre``.

    ``members`` has ``centre, id, asks, met, vec``; members that have met (at this centre, a round
    before) aren't compared again.  A centre has at most ``2 * k`` members, its rows follow one another
    in a partition, and the last centre of a batch waits for the next batch.
    """

    def compare(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = int((pdf["centre"] != pdf["centre"].iloc[-1]).sum()) if len(pdf) else 0
            held = pdf.iloc[last:]
            if last:
                yield found(pdf.iloc[:last])
        if held is not None and len(held):
            yield found(held)

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, asks, met = pdf["id"].to_numpy(), pdf["asks"].to_numpy(bool), pdf["met"].to_numpy(bool)
        widths = pdf["vec"].map(len).to_numpy()
        cuts = np.flatnonzero(np.diff(pdf["centre"].to_numpy())) + 1
        parts = []
        for width in np.unique(widths):  # members of a centre have one length
            rows = np.flatnonzero(widths == width)
            x = unit(stacked(pdf["vec"].iloc[rows]))
            at = np.searchsorted(rows, np.r_[0, cuts, len(pdf)])
            for lo, hi in zip(at[:-1], at[1:]):
                some = rows[lo:hi]
                mine = np.flatnonzero(asks[some]) if hi - lo > 1 else some[:0]
                if len(mine):
                    s = x[lo:hi][mine] @ x[lo:hi].T
                    s[met[some][mine][:, None] & met[some][None, :]] = -2
                    s[np.arange(len(mine)), mine] = -2
                    parts.append(_top(ids[some][mine], s, ids[some], explore, k))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [[], [], []]
        return pd.DataFrame(dict(zip(("a", "b", "sim"), columns)))

    return members.repartition("centre").sortWithinPartitions("centre", "id").mapInPandas(compare, "a long, b long, sim double")


def _descend(graph: DataFrame, lists: DataFrame | None, classes: DataFrame, threshold: float, explore: float, k: int) -> tuple[DataFrame, DataFrame]:
    """The graph after one local join, and the lists that met in it; ``lists`` are those of the round before."""
    full = graph.where(F.col("sim") >= threshold).groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    # Lists both ways are bounded: what a hub's reverse list loses, the audit decides on.
    back = _best(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"), k)
    both = written(graph.select(F.col("a").alias("centre"), F.col("b").alias("id")).unionByName(back.select(F.col("a").alias("centre"), F.col("b").alias("id"))).distinct(), "lists")
    members = both.join(full.select(F.col("a").alias("id"), F.lit(False).alias("asks")), "id", "left").withColumn("asks", F.coalesce("asks", F.lit(True)))
    if lists is None:
        members = members.withColumn("met", F.lit(False))
    else:
        members = members.join(lists.withColumn("met", F.lit(True)), ["centre", "id"], "left").withColumn("met", F.coalesce("met", F.lit(False)))
    # Centres whose members have all met, or of whom none asks, have nothing to tell.
    use = members.groupBy("centre").agg(F.max("asks").alias("some_asks"), F.min("met").alias("all_met")).where("some_asks and not all_met").select("centre")
    members = members.join(use, "centre", "left_semi").join(classes.select("id", "vec"), "id")
    return written(_best(graph.unionByName(_local(members, explore, k)), k), "graph"), both


def _exact(classes: DataFrame, labels: list[str], explore: float, k: int) -> DataFrame:
    """``a, b, sim``: nearest of all vectors of these labels, compared block by block."""
    rows = classes.where(F.col("label").isin(labels)).select("id", "label", F.size("vec").alias("size"), "vec")
    blocks = rows.groupBy("label", "size").agg(F.ceil(F.count("*") / EXACT_BLOCK).alias("blocks"))
    rows = rows.join(blocks, ["label", "size"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x, block, i, j = pdf["id"].to_numpy(), unit(stacked(pdf["vec"])), pdf["block"].to_numpy(), pdf["i"].iloc[0], pdf["j"].iloc[0]
        s = x @ x.T
        np.fill_diagonal(s, -2)
        if i != j:
            s[block[:, None] == block[None, :]] = -2
        return _nearest(ids, s, ids, explore, k)

    return pairs.groupBy("label", "size", "i", "j").applyInPandas(nearest, "a long, b long, sim double")


def _audit(links: DataFrame, classes: DataFrame, threshold: float) -> tuple[float, list[str]]:
    """Share of the true links of some vectors that are found, and the labels that fall short.

    ``classes`` has ``whole``: the component of vectors that are compared with all
    of it (else null), so links within it are found whether or not the graph holds them.
    The audited vectors go to the tasks in lots of at most ``AUDIT_BYTES``, a scan of all
    vectors for each, so neither driver nor worker holds more of them at once.
    """
    n, widest = classes.agg(F.count("*"), F.max(F.size("vec"))).first()
    m, lot = max(AUDIT, math.ceil(4 * math.sqrt(n))), max(1, AUDIT_BYTES // (8 * (widest or 1)))
    rows = classes.select("id", "label", "vec", F.coalesce("whole", F.lit(0)).alias("whole"), F.col("whole").isNotNull().alias("is_whole"))
    while True:
        some = rows.orderBy(F.xxhash64("id"), "id").limit(m)
        if lot < m:  # the limit leaves one partition, so its rows count on
            some = written(some.withColumn("at", F.monotonically_increasing_id()), "audit")
        by_label = {}
        for lo in range(0, min(m, n), lot):
            part = some if lot >= m else some.where(F.col("at").between(lo, lo + lot - 1)).drop("at")
            for r in _audited(part.toPandas(), links, rows, threshold):
                was = by_label.get(r["label"], (0, 0))
                by_label[r["label"]] = was[0] + r["n"], was[1] + r["hits"]
        total, hits = (sum(c[i] for c in by_label.values()) for i in (0, 1))
        if total >= AUDIT_LINKS or m >= min(n, AUDIT_MOST):
            return hits / total if total else 1.0, [label for label, (true, hit) in by_label.items() if hit < AUDIT_RECALL * true]
        m = min(4 * m, AUDIT_MOST)


def _audited(some: pd.DataFrame, links: DataFrame, rows: DataFrame, threshold: float) -> list:
    """``label, n, hits``: true links of ``some`` vectors, and those that are found."""
    groups = {key: (part["id"].to_numpy(), part["whole"].to_numpy(), part["is_whole"].to_numpy(bool), unit(stacked(part["vec"]))) for key, part in some.groupby([some["label"], some["vec"].map(len)])}
    shared = rows.sparkSession.sparkContext.broadcast(groups)

    def truth(batches):
        for pdf in batches:
            for key, part in pdf.groupby([pdf["label"], pdf["vec"].map(len)]):
                if key in shared.value:
                    ids, wholes, are_whole, y = shared.value[key]
                    x, mine, whole, is_whole = unit(stacked(part["vec"])), part["id"].to_numpy(), part["whole"].to_numpy(), part["is_whole"].to_numpy(bool)
                    for lo in range(0, len(ids), STRIP):
                        i, j = np.nonzero(x @ y[lo : lo + STRIP].T >= threshold)
                        a, b = ids[lo + j], mine[i]
                        other = a != b
                        sure = is_whole[i] & are_whole[lo + j] & (whole[i] == wholes[lo + j])
                        yield pd.DataFrame({"label": key[0], "a": a[other & ~sure], "b": b[other & ~sure], "sure": 0})
                        if times := int((sure & other).sum()):
                            yield pd.DataFrame({"label": [key[0]], "a": [0], "b": [0], "sure": [times]})

    true = rows.mapInPandas(truth, "label string, a long, b long, sure long")
    sure = F.col("sure") > 0  # such a row counts links, and names none
    found = true.join(links.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left")
    n, hits = F.when(sure, F.col("sure")).otherwise(1), F.when(sure, F.col("sure")).otherwise(F.coalesce("hit", F.lit(0)))
    out = found.groupBy("label").agg(F.sum(n).alias("n"), F.sum(hits).alias("hits")).collect()
    shared.unpersist()
    return out


def _blocks(members: DataFrame, classes: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """``a, n``: linked vectors of each member, comparing a component block by block."""
    cuts = F.ceil(F.col("n_members") / BLOCK)
    rows = members.join(sizes, "component").join(classes, "id")
    rows = rows.select("component", "id", "vec", "times", F.pmod(F.xxhash64("id"), cuts).alias("block"), cuts.alias("n_blocks"))
    left = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))

    def count(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"a": [], "n": []})
        mine, other, times = x["id"].to_numpy(), y["r_id"].to_numpy(), y["r_times"].to_numpy()
        p, q, n = unit(stacked(x["vec"])), unit(stacked(y["r_vec"])), np.zeros(len(x), np.int64)
        for lo in range(0, len(p), STRIP):
            s = p[lo : lo + STRIP] @ q.T >= threshold
            s &= mine[lo : lo + STRIP, None] != other[None, :]
            n[lo : lo + STRIP] = s @ times
        return pd.DataFrame({"a": mine, "n": n})

    right = rows.select(*[F.col(c).alias(f"r_{c}") for c in rows.columns])
    right = right.withColumn("mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r_n_blocks") - 1)))
    found = left.groupBy("component", "block", "other").cogroup(right.groupBy("r_component", "mine", "r_block")).applyInPandas(count, "a long, n long")
    return found.groupBy("a").agg(F.sum("n").alias("n"))


def embedding_dedup(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, explore: float = EXPLORE, k: int = K, trees: int = TREES, most_trees: int = MOST_TREES) -> DataFrame:
    """``vec_id, n_links, component_id, kept, audited_recall`` for every row."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    good = usable(F.col("vec")) & F.col("id").isNotNull() & F.col("label").isNotNull()
    classes = written(rows.where(good).groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("times")), "classes")
    if classes.groupBy("id").count().where("count > 1").limit(1).count():
        # Rows share ids: classes are numbered, and their smallest vec_id is put back at the end.
        classes = written(classes.withColumn("vec_id", F.col("id")).withColumn("id", F.monotonically_increasing_id()), "classes")
    else:
        classes = classes.withColumn("vec_id", F.col("id"))
    n = classes.count()
    graph, seeds, short = None, range(trees), []
    while True:
        exact = graph is not None and seeds.stop > most_trees
        fresh = _exact(classes, short, explore, k) if exact else _graph(classes, seeds, explore, k)
        graph = written(_best(fresh if graph is None else graph.unionByName(fresh), k), "graph")
        lists = None
        while not exact:
            old, met = graph, lists
            graph, lists = _descend(old, met, classes, threshold, explore, k)
            changed = graph.join(old, ["a", "b"], "left_anti").count()
            discard(old)
            if met is not None:
                discard(met)
            if changed <= STILL * n:
                break
        near = graph.where(F.col("sim") >= threshold).select("a", "b")
        links = written(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
        grouped = components(links)
        degree = near.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        large = written(grouped.join(degree.select(F.col("a").alias("id")), "id", "left_semi").select("component").distinct(), "large")
        members = grouped.join(large, "component", "left_semi")
        sizes = members.groupBy("component").agg(F.count("*").alias("n_members"))
        # Saturated members are compared with their whole component, so links within it count as found.
        known = classes.join(members.select("id", F.col("component").alias("whole")), "id", "left")
        recall, short = _audit(links, known, threshold)
        if exact or not short and recall >= AUDIT_RECALL:
            break
        seeds = range(seeds.stop, 2 * seeds.stop)
    times = classes.select(F.col("id").alias("b"), "times")
    plain = links.join(members.select(F.col("id").alias("a")), "a", "left_anti").join(times, "b").groupBy("a").agg(F.sum("times").alias("n"))
    linked = plain.unionByName(_blocks(members, classes, sizes, threshold)).withColumnRenamed("a", "id")
    state = classes.join(linked, "id", "left").join(grouped, "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = state.groupBy("component").agg(F.min("vec_id").alias("name"))
    state = state.join(names, "component").select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n"), "name")
    found = rows.where(good).join(state, ["label", "vec"]).select("id", "n", "name")
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("name"))
    out = found.unionByName(alone)
    kept = F.coalesce(F.col("id") == F.col("name"), F.lit(True)).alias("kept")
    return out.select(F.col("id").alias("vec_id"), F.col("n").cast("long").alias("n_links"), F.col("name").alias("component_id"), kept, F.lit(recall).alias("audited_recall"))
