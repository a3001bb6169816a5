"""Embedding near-duplicates by a subspace pigeonhole join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.components import components
from spanlake.session import cut_lineage

SUBSPACE = 8  # dimensions of a block
GRID = 2  # of them that make up a cell
CHUNK = 2048  # own rows of a cell that one task compares with each other


def usable(vector: str) -> str:
    """SQL: a vector that is not null, not zero, and has only finite components."""
    return f"{vector} IS NOT NULL AND size({vector}) > 0 AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists({vector}, x -> x <> 0)"


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A fixed random orthogonal matrix: after it every block of coordinates carries a like share of any distance."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def budgets(dims: int, squared: float) -> list[tuple[int, int, float]]:
    """Blocks `(from, to, budget)`: a squared distance within `squared` is within its share, by dimensions, in one block at least.
    The share is widened by what rounding can add."""
    cuts = list(range(0, dims, SUBSPACE)) + [dims]
    return [(a, b, squared * (b - a) / dims + 1e-9) for a, b in zip(cuts, cuts[1:], strict=False)]


def placements(classes: DataFrame, dims: int, squared: float) -> DataFrame:
    """`classes(label, node, vector)` -> `(label, node, block, cell, home)`: each vector in its own cell of every block's grid,
    and as a visitor in the cells after it (in one fixed order of the neighbours) that its budget reaches, so a near pair
    meets once in a block. Vectors themselves stay behind."""
    turn, blocks = rotation(dims), budgets(dims, squared)
    schema = T.StructType([classes.schema["label"], *T.StructType.fromDDL("node long, block int, cell string, home boolean").fields])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = np.array(frame["vector"].tolist(), dtype=np.float64)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn
            out = []
            for k, (a, b, budget) in enumerate(blocks):
                reach = math.sqrt(budget)
                lead = x[:, a : min(b, a + GRID)] / (3 * reach)
                cell, near = np.floor(lead).astype(np.int64), 1 / 3 + 1e-9
                steps = np.stack(np.meshgrid(*[[-1, 0, 1]] * lead.shape[1], indexing="ij"), axis=-1).reshape(-1, lead.shape[1])
                for step in steps:
                    if tuple(step) < (0,) * len(step):
                        continue
                    low, high = lead - cell <= near, cell + 1 - lead <= near
                    here = np.all(np.where(step == 0, True, np.where(step > 0, high, low)), axis=1)
                    if here.any():
                        part = frame.loc[here, ["label", "node"]].copy()
                        part["block"], part["home"] = k, not step.any()
                        part["cell"] = [",".join(map(str, c)) for c in (cell[here] + step).tolist()]
                        out.append(part)
            yield pd.concat(out)[schema.names]

    return classes.mapInPandas(place, schema)


def _compare(frame: pd.DataFrame, own: np.ndarray, pairs: bool, turn: np.ndarray, blocks: list, least: float) -> pd.DataFrame:
    """The links of one block's cell part: what each vector's links add up to, and one link to keep it connected."""
    raw = np.array(frame["vector"].tolist(), dtype=np.float64)
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    turned = unit @ turn
    nodes, copies = frame["node"].to_numpy(), frame["n"].to_numpy()
    k = int(frame["block"].iat[0])
    parent = np.arange(len(frame))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = np.zeros(len(frame), dtype=np.int64)
    mine = np.flatnonzero(own)
    a, b, budget = blocks[k]
    side = turned[:, a:b]
    square = (side**2).sum(axis=1)
    for start in range(0, len(frame), 256):
        rows = np.arange(start, min(start + 256, len(frame)))
        near = square[rows, None] + square[mine] - 2 * side[rows] @ side[mine].T <= budget
        near &= np.where(own[rows], rows if pairs else len(frame), -1)[:, None] < mine  # own pairs once; a visitor meets every own row
        one, two = np.nonzero(near)
        one, two = rows[one], mine[two]
        gap = (turned[one] - turned[two]) ** 2
        for c, d, earlier in blocks[:k]:  # a pair belongs to the first block whose budget it keeps
            fresh = gap[:, c:d].sum(axis=1) > earlier
            one, two, gap = one[fresh], two[fresh], gap[fresh]
        cosine = np.einsum("ij,ij->i", unit[one], unit[two])
        sure = cosine >= least
        one, two = one[sure], two[sure]
        np.add.at(links, one, copies[two])
        np.add.at(links, two, copies[one])
        for i, j in zip(one.tolist(), two.tolist(), strict=True):
            i, j = root(i), root(j)
            if i != j:
                parent[max(i, j)] = min(i, j)
    tied = links > 0
    return pd.DataFrame({"node": nodes[tied], "links": links[tied], "other": [nodes[root(int(i))] for i in np.flatnonzero(tied)]})


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """`(id, n_links, component_id)` per row: the other rows of its label at cosine `least` or more (in double precision),
    and the smallest id reachable over such links.

    Equal vectors of a label are one class, so thousands of copies are one row with a count. Unit vectors at cosine c
    are at squared distance 2 - 2c; rotated and split into blocks of 8 dimensions, a near pair keeps at least one block's share of it. Each
    block is a range join over grid cells of its first two dimensions; a pair within the share is verified on the whole
    vectors where both lie, in the first block that finds it. A cell with many rows is cut into chunks by hash that are compared chunk
    with chunk, so no task gathers a group. What a task returns is one row a vector (its number of links, and one
    link that keeps it connected), so a group of thousands of near copies gives no list of pairs, yet no link is lost.

    Vectors that are null, zero, or hold null or non-finite components, and rows whose label is null, link with nothing; nor do vectors of
    different lengths. Repeated rows count as vectors of their own; a row with a null id never names a component. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    fine = rows.where(F.col("label").isNotNull()).where(usable("vector"))
    classes = cut_lineage(fine.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    found = None
    for (dims,) in classes.select(F.size("vector")).distinct().collect():
        part = _links(classes.where(F.size("vector") == dims), dims, least)
        found = part if found is None else found.union(part)
    spark = vectors.sparkSession
    if found is None:
        found = spark.createDataFrame([], "node long, links long, other long")
    found = cut_lineage(found)
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("label", "vector", "rep", "n", "node").join(roots, "node", "left").join(linked, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least_id = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    per_class = named.join(least_id, "root").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    return rows.join(per_class, ["label", "vector"], "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def _links(classes: DataFrame, dims: int, least: float) -> DataFrame:
    """`(node, links, other)`: partial link counts of the vectors of one length, and links that connect them."""
    squared = 2 - 2 * least
    turn, blocks = rotation(dims), budgets(dims, squared)
    placed = cut_lineage(placements(classes.select("label", "node", "vector"), dims, squared))
    keys, zero = ["label", "block", "cell"], F.lit(0).cast("long")
    parts = placed.where("home").groupBy(*keys).agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("parts"))
    own_part = F.when(F.col("home"), F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(zero - 1)
    meets = F.sequence(F.greatest(F.col("own_part"), zero), F.col("parts") - 1)
    sent = placed.join(parts, keys).withColumn("own_part", own_part).withColumn("part", F.explode(meets)).withColumn("own", F.col("own_part") == F.col("part"))
    visits = sent.where("NOT own").groupBy(*keys, "part").agg(F.ceil(F.count("*") / (2 * CHUNK)).cast("long").alias("slices"))
    counted = sent.join(visits, [*keys, "part"], "left").withColumn("slices", F.coalesce("slices", zero + 1))
    slot = F.when(F.col("own"), F.sequence(zero, F.col("slices") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", "cell"), F.col("slices"))))
    dealt = counted.select("node", "own", *keys, "part", F.explode(slot).alias("slice"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", kind="stable", ignore_index=True)
        return _compare(frame, frame["own"].to_numpy(dtype=bool), frame["slice"].iat[0] == 0, turn, blocks, least)

    whole = dealt.join(classes.select("node", "n", "vector"), "node")
    return whole.groupBy(*keys, "part", "slice").applyInPandas(compare, "node long, links long, other long")
