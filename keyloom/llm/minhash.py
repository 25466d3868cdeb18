"""Near-duplicate documents by SuperMinHash signatures, banding, verification on full sets and union of links.

Documents with the same shingle set form a class; only one row of a class goes on. Signatures of
classes are cut into bands. In each bucket of a band the least member is linked to the others
(a star, never all pairs), the links are verified on full sets, and components are built. Where a
bucket still holds several components, other pivots are tried, and what is left is compared block
by block across components, so the stars lose no pair that shares a bucket.

Two members of a bucket whose signatures agree in fewer slots than the wanted similarity less SLACK
(over 4 standard deviations, so less than one true link in 100,000 is passed over, far fewer than banding
passes over) are not compared further.

Defined results: a null or empty text, or one without words, has an empty set and links with
nothing. Rows with the same id share its class if their texts do. A row whose id is null never
names a component: it takes that of its class, or null (and is kept) if its class has no id. Other
columns than the two named are not read; ``keep_one`` carries columns of any name. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .components import components, forest
from .runtime import Scratch, fresh, lean, prepare, shuffle_width
from .textkeys import mix, shingles, word_hashes

#: 21 bands of 6 slots: documents with a Jaccard similarity of 0.85 share a bucket with probability 0.99995, those of 0.8 with 0.998.
SLOTS, BAND = 126, 6
#: How far the share of equal signature slots may lie below the wanted similarity before two members of a bucket are not compared further (over 4 standard deviations), pivots tried besides the least member, and rows of a block.
SLACK, PIVOTS, BLOCK_ROWS = 0.15, 2, 128
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def signature(items: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of a non-empty set of 64-bit hashes: slot k holds the least r + j with which an element comes to k.

    An element's j-th step of a random permutation leads to a slot with the value r + j, 0 <= r < 1.
    All elements take step j together; when every slot is below j + 1, later steps cannot lower one.
    """
    sig = np.full(slots, np.inf)
    x = mix(items + _STEP)
    k = ((x & _LOW) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(sig, k, (x >> np.uint64(32)).astype(np.float64) * 2.0**-32)
    if sig.max() < 1:
        return sig
    rows = np.arange(len(items))
    perm = np.tile(np.arange(slots, dtype=np.int16), (len(items), 1))
    perm[rows, k], perm[rows, 0] = 0, k
    for j in range(1, slots):
        x = mix(items + np.array([j + 1], np.uint64) * _STEP)
        k = j + ((x & _LOW) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        slot = perm[rows, k]
        perm[rows, k] = perm[rows, j]
        perm[rows, j] = slot
        np.minimum.at(sig, slot, (x >> np.uint64(32)).astype(np.float64) * 2.0**-32 + j)
        if sig.max() < j + 1:
            break
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    v = mix((sig * 2.0**32).astype(np.uint64))
    mult = mix(np.arange(1, BAND + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    bands = v.reshape(-1, BAND)
    return mix((bands * mult).sum(axis=1, dtype=np.uint64) + np.arange(len(bands), dtype=np.uint64) * _STEP)


def _sketches(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """One row per document: id, hash of the text, n, class key (two hashes of the sorted set), one byte of every slot, band keys."""
    names = ["id", "mark", "n", "k1", "k2", "sketch", "bands"]
    kinds = [LongType(), LongType(), LongType(), LongType(), LongType(), BinaryType(), ArrayType(LongType())]
    schema = StructType([StructField(n, t) for n, t in zip(names, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k1, k2, sketch, bands = [], [], [], [], []
            for s in shingles(*word_hashes([t or "" for t in b.column(2).to_pylist()]), width):
                n.append(len(s))
                if not len(s):
                    k1.append(0), k2.append(0), sketch.append(None), bands.append(None)
                    continue
                at = mix(s) * (np.arange(len(s), dtype=np.uint64) * np.uint64(2) + np.uint64(1))
                k1.append(int(at.sum(dtype=np.uint64).view(np.int64)))
                k2.append(int(mix(at ^ s).sum(dtype=np.uint64).view(np.int64)))
                sig = signature(s)
                sketch.append((mix((sig * 2.0**32).astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).tobytes())
                bands.append(band_keys(sig).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=names)

    text = F.col(f"`{text_col}`")
    return df.select(F.col(f"`{id_col}`").cast("long"), F.xxhash64(text), text).mapInArrow(lean(run), schema)


def _sets(df: DataFrame, width: int) -> DataFrame:
    """(id, what) of (id, text): the shingle set of each."""
    schema = StructType([StructField("id", LongType()), StructField("what", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingles(*word_hashes([t or "" for t in b.column(1).to_pylist()]), width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "what"])

    return df.select("id", "text").mapInArrow(lean(run), schema)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on their full sets."""
    one = sets.select(F.col("id").alias("b"), F.col("what").alias("what_b"))
    two = sets.select(F.col("id").alias("a"), F.col("what").alias("what_a"))
    both = F.size(F.array_intersect("what_a", "what_b"))
    joined = pairs.join(one, "b").join(two, "a").select("a", "b", both.alias("both"), (F.size("what_a") + F.size("what_b")).alias("sum"))
    return joined.where(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent).select("a", "b")


def _dealt(rows: DataFrame, *carry: str) -> DataFrame:
    """Rows of buckets (key, id, comp, blocks) once for each pair of blocks that theirs is in, sorted by the pair. Side 1 meets side 2; side 0 is both."""
    block = F.pmod(F.xxhash64("id"), "blocks")
    out = rows.withColumn("x", block).withColumn("y", F.explode(F.expr("sequence(0L, blocks - 1)")))
    side = F.when(F.col("x") == F.col("y"), 0).when(F.col("x") < F.col("y"), 1).otherwise(2)
    out = out.select("key", "id", "comp", *carry, F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), side.alias("side"))
    return out.repartition(shuffle_width(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")


def _pairs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int, int]]:
    """Whole pairs of blocks (table, from, to) of dealt rows."""
    held, size = [], 0

    def cut(t: pa.Table) -> Iterator[tuple[pa.Table, int, int]]:
        k, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
        edge = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]])).tolist()
        yield from ((t, x, y) for x, y in zip(edge, edge[1:], strict=False))

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= 4 * BLOCK_ROWS:
            t = pa.Table.from_batches(held)
            k, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
            whole = int(np.flatnonzero((k == k[-1]) & (i == i[-1]) & (j == j[-1]))[0])  # the last pair may go on
            if whole:
                yield from cut(t.slice(0, whole))
            held, size = t.slice(whole).to_batches(), t.num_rows - whole
    if size:
        yield from cut(pa.Table.from_batches(held))


def _promising(rows: DataFrame, least: float) -> DataFrame:
    """(key, id) of the rows with a row of another component in their bucket whose sketch agrees enough. No pair leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, lo, hi in _pairs_of_blocks(batches):
            part = t.slice(lo, hi - lo)
            comp, side, ids = (part.column(c).to_numpy() for c in ("comp", "side", "id"))
            s = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(hi - lo, -1)
            right, hit = np.flatnonzero(side != 1), np.zeros(hi - lo, bool)
            for i in np.flatnonzero(side != 2).tolist():
                k = right[comp[right] != comp[i]]
                k = k[(s[k] == s[i]).mean(axis=1) >= least] if len(k) else k
                if len(k):
                    hit[k] = hit[i] = True
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(part.column("key").to_numpy()[hit]), pa.array(ids[hit])], names=["key", "id"])

    return _dealt(rows, "sketch").mapInArrow(lean(run), "key long, id long").distinct()


def payloads(column: pa.ChunkedArray) -> list:
    """The values of a column; lists of integers as numpy arrays, since Python integers would take five times their memory."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    return [x.values.to_numpy() for x in column]


def _linked_blocks(rows: DataFrame, exact: Callable[[list, list], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Edges (a, b) of a forest with the components that the true links between the rows of a pair of blocks make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, lo, hi in _pairs_of_blocks(batches):
            part = t.slice(lo, hi - lo)
            side, ids = part.column("side").to_numpy(), part.column("id").to_numpy()
            what = payloads(part.column("what"))
            left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
            i, j = exact([what[x] for x in left.tolist()], [what[x] for x in right.tolist()]) if len(left) and len(right) else ([], [])
            a, b = forest(ids[left[i]], ids[right[j]]) if len(i) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return _dealt(rows, "what").mapInArrow(lean(run), "a long, b long")


def jaccard_links(left: list, right: list, percent: int) -> np.ndarray:
    """Which sets (lists of integers) of ``left`` and ``right`` have 100 * intersection >= percent * union, by products of incidence matrices."""
    sets = [np.asarray(x, np.int64) for x in (*left, *right)]
    sizes = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, item, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[item] > 1
    row, item = row[shared], np.unique(item[shared], return_inverse=True)[1]
    both = np.zeros((len(left), len(right)))
    order = np.argsort(item, kind="stable")
    row, item = row[order], item[order]
    for lo in range(0, int(item.max()) + 1 if len(item) else 0, 8192):
        x, y = np.searchsorted(item, [lo, lo + 8192])
        m = np.zeros((len(sets), 8192), np.float32)
        m[row[x:y], item[x:y] - lo] = 1
        both += m[: len(left)] @ m[len(left) :].T
    union = sizes[: len(left), None] + sizes[None, len(left) :] - both
    return 100 * both >= percent * union


def linked(scratch: Scratch, reps: DataFrame, source: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame, DataFrame], DataFrame], exact: Callable[[list, list], tuple[np.ndarray, np.ndarray]], least: float) -> DataFrame:
    """(node, component) of the rows (id, sketch, bands; ids distinct) that share a bucket and are verified.

    ``source(ids)`` gives (id, what); ``verify(pairs, that)`` keeps the true links among pairs (a, b), and
    ``exact(left, right)`` gives true links (places in two lists of ``what``) that connect all that are linked.
    ``least`` is the share of equal sketch bytes below which two members of a bucket are no candidates.
    """
    buckets = scratch.save(reps.where("sketch is not null").select("id", F.explode("bands").alias("key")).distinct())
    full = scratch.save(buckets.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi"))
    members = scratch.save(buckets.join(full, "key").select("key", "id", "lo"))
    scratch.drop(buckets)
    scratch.drop(full)
    stars = scratch.save(members.where("lo < id").select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct())
    involved = scratch.save(members.select("id").distinct())
    sets = scratch.save(source(involved))
    comps = scratch.save(components(scratch, scratch.save(verify(stars, sets))))
    sketch = scratch.save(reps.select("id", "sketch").where("sketch is not null").join(involved, "id", "left_semi").dropDuplicates(["id"]))
    for turn in range(PIVOTS + 1):
        named = members.select("key", "id").join(comps.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
        named = scratch.save(named)
        mixed = F.xxhash64("id", F.lit(turn))
        split = named.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("rows"), F.min_by("id", mixed).alias("pivot"), F.min_by("comp", mixed).alias("pivot_comp"))
        split = scratch.save(split.where("c0 < c1"))
        most = split.agg(F.max("rows")).first()[0]
        if most is None:
            break
        last = turn == PIVOTS or most <= BLOCK_ROWS  # buckets of one block need no further pivots
        if last:
            some = lambda rows: rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
            open_ = scratch.save(_promising(named.join(split.select("key", F.ceil(F.col("rows") / BLOCK_ROWS).alias("blocks")), "key").join(sketch, "id"), least))
            open_ = open_.join(scratch.save(some(open_)), "key").join(comps.select(F.col("node").alias("id"), "component"), "id", "left").join(sets, "id")
            found = scratch.save(_linked_blocks(open_.withColumn("comp", F.coalesce("component", "id")), exact))
        else:
            more = named.join(split, "key").where("comp != pivot_comp").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
            found = scratch.save(verify(scratch.save(more.distinct()), sets))
        comps = scratch.save(components(scratch, comps.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(found)))
        scratch.drop(named)
        if last:
            break
    for old in (members, stars, involved, sets, sketch):
        scratch.drop(old)
    return comps


def near_duplicates(df: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id, kept, text_hash. Links: Jaccard similarity of at least ``percent``/100."""
    spark = df.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "minhash")
    all_rows = scratch.save(_sketches(df, id_col, text_col, width))
    classes = scratch.save(all_rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("rep")))
    reps = all_rows.select("id", "sketch", "bands").join(classes.where("rep is not null").select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    comps = linked(
        scratch,
        reps,
        lambda ids: _sets(texts.join(ids, "id", "left_semi"), width).dropDuplicates(["id"]),
        lambda pairs, sets: _verified(pairs, sets, percent),
        lambda left, right: np.nonzero(jaccard_links(left, right, percent)),
        percent / 100 - SLACK,
    )
    of_class = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component_id"))
    of_class = scratch.save(of_class)
    out = all_rows.select("id", "mark", "k1", "k2", "n").join(of_class, ["k1", "k2", "n"], "left")
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("mark").alias("text_hash"))
    kept = F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull())
    return out.select(id_col, "n_shingles", "component_id", kept.alias("kept"), "text_hash")


def keep_one(df: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that near_duplicates keeps, with all columns; rows with the same id and text stay once."""
    own_id, own_hash, kept_id, kept_hash = fresh(df, "own_id", "own_hash", "kept_id", "kept_hash")
    found = near_duplicates(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), percent, width, id_col, text_col)
    kept = found.where("kept").select(F.col(f"`{id_col}`").alias(kept_id), F.col("text_hash").alias(kept_hash))
    kept = Scratch(df.sparkSession, "kept").save(kept.distinct())
    rows = df.withColumn(own_id, F.col(f"`{id_col}`").cast("long")).withColumn(own_hash, F.xxhash64(F.col(f"`{text_col}`")))
    rows = rows.join(kept, F.col(own_id).eqNullSafe(F.col(kept_id)) & (F.col(own_hash) == F.col(kept_hash)), "left_semi")
    return rows.dropDuplicates([own_id, own_hash]).select(*[F.col(f"`{c}`") for c in df.columns])
