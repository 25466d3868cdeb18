"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors by a 64-bit key of random hyperplane signs (most significant first) and
compares every vector with the ``window`` next ones; pairs are verified in double precision on the
vectors themselves. A pass's comparisons inside a partition leave as a spanning forest of the links
found. The rows near a partition's bounds meet those of the next one in a second step, which runs on
over partitions that are shorter than a window, so the window is the same wherever bounds fall.
The union of all passes gives components. The first passes are as many as vectors spread evenly need.
Then recall is measured: a bounded sample of vectors is compared exactly with all others, and further
passes with wider windows follow until the wanted share of the sample's links lies inside components.
Where vectors lie close together, a plane separates few of them, so there it takes these rounds.

Links are then counted inside components. Vectors closer to the component's pivot than half the
threshold angle all link with each other (by the triangle inequality for angles), so they are
counted without comparison; each of the others is compared with the whole component, in blocks.

Equal vectors form a class, of which one goes through the passes. Vectors of each length go through
passes of their own. Vectors travel in the precision of their column.

Defined results: vectors that are null, zero, or hold null or non-finite components link with
nothing, and so do rows with a null id. An id is one vector: of rows that repeat an id the vector
least by its bytes speaks for all of them, and they get the same values. Other columns than the two named are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, IntegerType, LongType, StructField, StructType

from .components import components
from .runtime import Scratch, lean, prepare, shuffle_width

WINDOW, RECALL, SEED, TILE, BLOCK = 64, 0.97, 7, 512, 1024
#: Vectors whose links are all known by comparison (the bound of the sample), partners of each that are kept of a batch, and window and passes of the first further round (the window doubles with each).
SAMPLE, PARTNERS, WIDER, MORE = 4096, 16, 1024, 8


def passes_for(rows: int, least: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which two vectors at the threshold have been in one window with probability ``recall``."""
    same_bit = 1 - math.acos(least) / math.pi
    together = same_bit ** max(1.0, math.log2(max(2, rows) / window))
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - min(0.95, together))))


def planes(number: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, number]).standard_normal((64, dim))


def _unit(raws: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision of vectors of 4 or 8 bytes a component."""
    v = np.frombuffer(b"".join(raws), "<f4" if raws and len(raws[0]) == 4 * dim else "<f8").reshape(len(raws), dim).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim) of the vectors that can link: bytes of their components, as doubles unless the column holds floats."""
    kind = df.schema[vector_col].dataType
    code = "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"
    schema = StructType([StructField("id", LongType()), StructField("v", BinaryType()), StructField("dim", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, raws, dims = [], [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                values = x.values if x.is_valid else None
                if i is None or values is None or not len(values) or values.null_count:
                    continue
                v = values.to_numpy(zero_copy_only=False).astype(code)
                v = v + v.dtype.type(0)  # minus zero is zero
                if np.isfinite(v).all() and v.any():
                    ids.append(i), raws.append(v.tobytes()), dims.append(len(v))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raws, pa.binary()), pa.array(dims, pa.int32())], names=schema.names)

    return df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{vector_col}`")).mapInArrow(lean(run), schema)


def _forest(ids: np.ndarray, unit: np.ndarray, least: float, window: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between each row and the ``window`` next ones."""
    n, parent = len(ids), list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for lo in range(0, n, TILE):
        hi = min(n, lo + TILE + window)
        s = unit[lo : min(n, lo + TILE)] @ unit[lo:hi].T
        i, j = np.nonzero(s >= least)
        near = (j > i) & (j <= i + window)
        for a, b in zip((i[near] + lo).tolist(), (j[near] + lo).tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[y] = x
                out.append((int(ids[a]), int(ids[b])))
    return out


def _pass_links(vectors: DataFrame, dim: int, passes: int, least: float, window: int, rows: int, first: int = 0) -> DataFrame:
    """Of the sorted passes (numbered from ``first``): links within partitions (kind 0), rows near the bounds (kind 1, with their place in the partition's part of the pass) and numbers of rows of a partition in its first and last pass (kind 2, as place)."""
    keyed = StructType([StructField("turn", IntegerType()), StructField("order", LongType()), StructField("id", LongType()), StructField("v", BinaryType())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [planes(first + p, dim) for p in range(passes)]
        bits = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
        for b in batches:
            unit = _unit(b.column(1).to_pylist(), dim) if b.num_rows else np.zeros((0, dim))
            for p in range(passes):
                key = ((unit @ own[p].T > 0) * bits).sum(axis=1, dtype=np.uint64) ^ np.uint64(1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, p, np.int32)), pa.array(key.view(np.int64)), b.column(0), b.column(1)], names=keyed.names)

    out = StructType([StructField("kind", IntegerType()), StructField("turn", IntegerType()), StructField("part", IntegerType()), StructField("side", IntegerType()), StructField("place", LongType()), StructField("a", LongType()), StructField("b", LongType()), StructField("v", BinaryType())])
    kinds = pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, raws, turns = np.zeros(0, np.int64), [], np.zeros(0, np.int32)
        count: dict[int, int] = {}
        done = 0

        def made(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=out.names)

        for b in batches:
            turns = np.concatenate([turns, b.column("turn").to_numpy()])
            ids = np.concatenate([ids, b.column("id").to_numpy()])
            raws += b.column("v").to_pylist()
            rows = []
            for t, i, v in zip(b.column("turn").to_pylist(), b.column("id").to_pylist(), b.column("v").to_pylist(), strict=True):
                n = count.get(t, 0)
                if n < window and (not count or t == next(iter(count))):  # the first rows of the partition belong to the first pass in it
                    rows.append((1, t, part, 0, n, i, None, v))
                count[t] = n + 1
            if len(ids) - done >= 4 * TILE:
                rows += _links(ids, raws, turns, dim, least, window)
                ids, raws, turns = ids[-window:], raws[-window:], turns[-window:]
                done = len(ids)
            yield made(rows)
        rows = _links(ids, raws, turns, dim, least, window)
        if count:
            begin, end = next(iter(count)), int(turns[-1])
            rows += [(2, t, part, None, count[t], None, None, None) for t in {begin, end}]
            tail = np.flatnonzero(turns == end)[-window:].tolist()
            if begin != end or count[end] >= window:  # else these are the first rows already
                rows += [(1, end, part, 1, count[end] - len(tail) + k, int(ids[i]), None, raws[i]) for k, i in enumerate(tail)]
        yield made(rows)

    spread = vectors.select("id", "v").mapInArrow(lean(keys), keyed)
    n = max(1, min(shuffle_width(vectors.sparkSession), rows * passes // (4 * window)))  # a partition holds several windows
    return spread.repartitionByRange(n, "turn", "order", "id").sortWithinPartitions("turn", "order", "id").mapInArrow(lean(compare), out)


def chains(counts: list[tuple[int, int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """(turn, part, side, chain): the runs of rows near bounds that follow on each other without a gap.

    ``counts``: (turn, part, rows) of the first and last pass of every partition. A partition with a
    whole window of a pass ends a run with its first rows and begins another with its last ones; a
    shorter one lies inside a run.
    """
    out, chain, before = [], 0, None
    firsts: dict[int, int] = {}
    for turn, part, _ in counts:
        firsts[part] = min(turn, firsts.get(part, turn))
    for turn, part, n in sorted(counts):
        if turn != before:
            chain, before = chain + 1, turn
        if firsts[part] == turn:
            out.append((turn, part, 0, chain))
        if n >= window:
            chain += 1
        if n >= window or firsts[part] != turn:
            out.append((turn, part, 1, chain))
    return out


def _links(ids: np.ndarray, raws: list[bytes], turns: np.ndarray, dim: int, least: float, window: int) -> list[tuple]:
    rows = []
    for t in np.unique(turns).tolist():
        k = np.flatnonzero(turns == t)
        if len(k) > 1:
            unit = _unit([raws[i] for i in k.tolist()], dim)
            rows += [(0, t, None, None, None, a, b, None) for a, b in _forest(ids[k], unit, least, window)]
    return rows


def _sampled_links(classes: DataFrame, rows: int, dim: int, least: float) -> DataFrame:
    """(a, b): links of a sample of vectors a, found by comparing each with all vectors."""
    share = min(1.0, SAMPLE / max(1, rows))
    some = classes.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30))).select("id", "v").collect()
    ids, raws = np.array([r[0] for r in some], np.int64), [bytes(r[1]) for r in some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = _unit(raws, dim) if raws else np.zeros((0, dim))
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            own = b.column("id").to_numpy()
            i, j = np.nonzero((unit @ _unit(b.column("v").to_pylist(), dim).T >= least) & (ids[:, None] != own[None, :]))
            order = np.lexsort((np.random.default_rng(int(own[0]) & 0xFFFF).random(len(i)), i))
            i, j = i[order], j[order]
            few = np.arange(len(i)) - np.searchsorted(i, i) < PARTNERS
            yield pa.RecordBatch.from_arrays([pa.array(ids[i[few]]), pa.array(own[j[few]])], names=["a", "b"])

    return classes.select("id", "v").mapInArrow(lean(run), "a long, b long")


def _measured_recall(links: DataFrame, comps: DataFrame) -> float | None:
    """Share of the links that lie inside components, over all or as the mean of each vector's share, whichever is less; None if there are no links to measure by."""
    of_a, of_b = (comps.select(F.col("node").alias(c), F.col("component").alias("c" + c)) for c in "ab")
    inside = F.coalesce("ca", "a") == F.coalesce("cb", "b")
    each = links.join(of_a, "a", "left").join(of_b, "b", "left").groupBy("a").agg(F.count_if(inside).alias("met"), F.count("*").alias("all"))
    r = each.agg(F.sum("met") / F.sum("all"), F.avg(F.col("met") / F.col("all"))).first()
    return None if r[0] is None else min(r[0], r[1])


def _counted(members: DataFrame, dim: int, least: float) -> DataFrame:
    """(id, links): links of each vector inside its component (rows: comp, id, v, copies, pivot's v, block number and number of blocks)."""
    half = math.cos(math.acos(least) / 2)

    def core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = (_unit(b.column("v").to_pylist(), dim) * _unit(b.column("pv").to_pylist(), dim)).sum(axis=1) >= half + 1e-12
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("comp", "id", "v", "copies")], pa.array(near)], names=["comp", "id", "v", "copies", "core"])

    return members.select("comp", "id", "v", "copies", "pv").mapInArrow(lean(core), "comp long, id long, v binary, copies long, core boolean")


def _compared(rows: DataFrame, dim: int, least: float) -> DataFrame:
    """(id, links) partial sums: links of the rows outside the core (side 1, in blocks i) with all rows of their component (side 2, in blocks j), counted for both unless the other is outside too."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["side"] == 1], group[group["side"] == 2]
        if not len(left) or not len(right):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
        u, w = _unit(list(left["v"]), dim), _unit(list(right["v"]), dim)
        ids_u, ids_w = left["id"].to_numpy(), right["id"].to_numpy()
        core, cu, cw = right["core"].to_numpy(dtype=bool), left["copies"].to_numpy(), right["copies"].to_numpy()
        links_u, links_w = np.zeros(len(u), np.int64), np.zeros(len(w), np.int64)
        for lo in range(0, len(u), TILE):
            hit = (u[lo : lo + TILE] @ w.T >= least) & (ids_u[lo : lo + TILE, None] != ids_w[None, :])
            links_u[lo : lo + TILE] = hit @ cw
            links_w += cu[lo : lo + TILE] @ hit
        return pd.DataFrame({"id": np.concatenate([ids_u, ids_w[core]]), "links": np.concatenate([links_u, links_w[core]])})

    return rows.groupBy("comp", "i", "j").applyInPandas(run, "id long, links long")


def _of_length(scratch: Scratch, valid: DataFrame, dim: int, least: float, window: int) -> DataFrame:
    """(v, component_id, n_links) of the distinct vectors of one length."""
    spark = valid.sparkSession
    classes = scratch.save(valid.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    rows = int(classes.count())

    def linked(passes: int, window: int, first: int, before: DataFrame | None) -> DataFrame:
        found = scratch.save(_pass_links(classes, dim, passes, least, window, rows, first))

        def meet(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["part", "place"])
            pairs = _forest(group["a"].to_numpy(), _unit(list(group["v"]), dim), least, window) if len(group) > 1 else []
            return pd.DataFrame(pairs, columns=["a", "b"]).astype("int64")

        # two numbers for each partition reach the driver, whatever the rows
        counts = [tuple(r) for r in found.where("kind = 2").select("turn", "part", "place").collect()]
        runs = spark.createDataFrame(chains(counts, window), "turn int, part int, side int, chain int")
        across = found.where("kind = 1").join(runs, ["turn", "part", "side"]).groupBy("chain").applyInPandas(meet, "a long, b long")
        edges = found.where("kind = 0").select("a", "b").unionByName(across)
        if before is not None:
            edges = edges.unionByName(before.select(F.col("component").alias("a"), F.col("node").alias("b")))
        out = scratch.save(components(scratch, edges))
        scratch.drop(found)
        scratch.release()
        return out

    done = passes_for(rows, least, window)
    comps = linked(done, window, 0, None)
    known = scratch.save(_sampled_links(classes, rows, dim, least))
    while True:
        recall = _measured_recall(known, comps)
        # a sample of all vectors without a link says that there is none; a smaller one says nothing, so one wider round follows
        if (recall is None and (rows <= SAMPLE or window >= WIDER)) or (recall is not None and recall >= RECALL):
            break
        window = max(WIDER, 2 * window)
        comps = linked(MORE, window, done, comps)
        done += MORE
    # link counts inside the components of more than one class
    named = classes.join(comps.withColumnRenamed("node", "id"), "id").select(F.col("component").alias("comp"), "id", "v", "copies")
    named = scratch.save(named)
    pivots = scratch.save(named.where("id = comp").groupBy("comp").agg(F.min("v").alias("pv")))
    marked = scratch.save(_counted(named.join(pivots, "comp"), dim, least))
    sizes = scratch.save(marked.groupBy("comp").agg(F.count("*").alias("rows"), F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("inner"), F.count_if(~F.col("core")).alias("outer")))
    withs = scratch.save(marked.join(sizes, "comp"))
    base = withs.select("id", F.when(F.col("core"), F.col("inner") - F.col("copies")).otherwise(0).alias("links"))
    # a row of the core is sent once for each block of rows outside it, and these once for each block of all rows
    open_ = withs.where("outer > 0").withColumn("m", F.ceil(F.col("outer") / BLOCK)).withColumn("n", F.ceil(F.col("rows") / BLOCK))
    outside = open_.where("not core").withColumn("i", F.pmod(F.xxhash64("id"), F.col("m"))).withColumn("j", F.explode(F.expr("sequence(0L, n - 1)"))).withColumn("side", F.lit(1))
    whole = open_.withColumn("j", F.pmod(F.xxhash64("id"), F.col("n"))).withColumn("i", F.explode(F.expr("sequence(0L, m - 1)"))).withColumn("side", F.lit(2))
    dealt = outside.unionByName(whole).select("comp", "id", "v", "copies", "core", "i", "j", "side")
    links = base.unionByName(_compared(dealt, dim, least)).groupBy("id").agg(F.sum("links").alias("links"))
    return scratch.save(classes.join(comps.withColumnRenamed("node", "id"), "id", "left").join(links, "id", "left").select("v", F.coalesce("component", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))


def near_duplicates(df: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", window: int = WINDOW) -> DataFrame:
    """One row per row of ``df``: id, n_links, component_id, kept (id names the component)."""
    spark = df.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "vectors")
    first = _valid(df, id_col, vector_col).groupBy("id").agg(F.min(F.struct("v", "dim")).alias("x"))
    valid = scratch.save(first.select("id", "x.v", "x.dim"))
    dims = [int(r[0]) for r in valid.select("dim").distinct().orderBy("dim").collect()]
    ids = df.select(F.col(f"`{id_col}`").cast("long").alias("id"))
    if not dims:
        return ids.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    of_class = None
    for dim in dims:
        part = _of_length(scratch, valid.where(F.col("dim") == dim), dim, least, window)
        of_class = part if of_class is None else of_class.unionByName(part)
    of_row = valid.join(of_class, "v").select("id", "component_id", "n_links")
    out = ids.join(of_row, "id", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
