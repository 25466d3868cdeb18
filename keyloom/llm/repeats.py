"""Removal of byte strings that occur earlier in the corpus, by ranking positions at growing lengths.

As in prefix doubling, positions are ranked by a short string first, positions whose rank is unique
drop out, and the others are ranked again by longer strings until they are unique or past the
threshold. Two things keep the sorts small. The first ranking takes only sampled positions: in each
window of ``width`` bytes the position whose ``SEED`` bytes have the least hash (the leftmost such),
so equal windows sample the same place and none is lost. The second ranking works on the stretch
around a position that is still tied, where a task ranks all windows of ``width`` bytes at once.

Order is (id, start). A position that very many documents share is dealt over several tasks by a
salt; each ranks its part, and only the first of equal windows in a part goes on to a last ranking.

Defined results: null and empty texts, and those shorter than ``width``, lose nothing. Rows with
the same id count as one document: a string at the same start of two of them is not earlier in
either. A null id comes before all others. Matches never cross documents. Rows are told apart by id
and a hash of the text, so no list holds more than one text's positions, whatever ids repeat. Columns
of any name are carried; added ones take a leading underscore where they clash. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .runtime import Scratch, fresh, lean, prepare, shuffle_width
from .textkeys import mix, prefix_hashes

WIDTH, SEED = 100, 24
#: Samples of one seed above which it is dealt over several tasks, and rows of each deal.
HOT, DEAL = 4000, 2000
#: Bytes of text worked on at once, and bytes of stretches ranked at once (some 100 bytes of memory each).
BLOCK, STRETCHES = 1 << 18, 1 << 19
_NULL_ID = -(1 << 63)


def samples(raws: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions of texts: text, position, seed hash, and the first and last start of the windows that sample it."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    i = 0
    while i < len(raws):
        j, n = i, 0
        while j < len(raws) and (j == i or n + len(raws[j]) <= BLOCK):
            n += len(raws[j])
            j += 1
        sizes = np.array([len(r) for r in raws[i:j]])
        ends = np.cumsum(sizes)
        for own, part in zip(out, _block(np.frombuffer(b"".join(raws[i:j]), np.uint8), ends - sizes, ends, width), strict=True):
            own.append(part)
        out[0][-1] += i
        i = j
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _block(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> list[np.ndarray]:
    n = len(b) - width + 1
    if n < 1:
        return [np.zeros(0, np.int64)] * 5
    h, down = prefix_hashes(b)
    g = mix((h[SEED:] - h[:-SEED]) * down[: len(b) - SEED + 1])
    step = 1 << 23  # a place has 24 bits beside 40 bits of hash
    least = np.zeros(n, np.int64)
    span = width - SEED + 1
    for lo in range(0, n, step):
        v = (g[lo : lo + step + span] & np.uint64(0xFFFFFFFFFF000000)) | np.arange(min(step + span, len(g) - lo), dtype=np.uint64)
        m, size = v, 1
        while 2 * size <= span:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < span:
            m = np.minimum(m[: len(m) - (span - size)], m[span - size :])
        m = m[: min(step, n - lo)]
        least[lo : lo + len(m)] = (m & np.uint64(0xFFFFFF)).astype(np.int64) + lo
    valid = np.ones(len(b), bool)
    tails = np.maximum(starts[:, None], ends[:, None] - 1 - np.arange(width - 1))
    valid[tails[ends > starts].ravel()] = False
    valid = valid[:n]
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    stop = ~valid
    stop[:-1] |= (least[1:] != least[:-1]) | ~valid[1:]
    last = np.flatnonzero(valid & np.concatenate([stop[:-1], [True]]))
    text = np.searchsorted(ends, first, side="right")
    base = starts[text]
    at = least[first]
    return [text, at - base, g[at].view(np.int64), first - base, last - base]


def _raw(texts: list[str | None]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def _seeds(docs: DataFrame, width: int) -> DataFrame:
    """(key, mark, seeds, counts): the distinct seed hashes of each row and how often each is sampled in it."""
    schema = StructType([StructField("key", LongType()), StructField("mark", LongType()), StructField("seeds", ArrayType(LongType())), StructField("counts", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = _raw(b.column(2).to_pylist())
            text, _, seed, _, _ = samples(raws, width)
            cut = np.searchsorted(text, np.arange(len(raws) + 1))
            seeds, counts = [], []
            for i, j in zip(cut, cut[1:], strict=False):
                s, n = np.unique(seed[i:j], return_counts=True)
                seeds.append(s)
                counts.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(seeds, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))], names=schema.names)

    return docs.select("key", "mark", "text").mapInArrow(lean(run), schema)


def _stretches(tied: DataFrame, cols: list[str], width: int) -> DataFrame:
    """Stretches (seed, salt, salts, key, mark, start, bytes) of rows with key, text, mark, seeds and counts: all windows that sample a tied position."""
    names = ["seed", "salt", "salts", "key", "mark", "start", "bytes"]
    kinds = [LongType(), IntegerType(), IntegerType(), LongType(), LongType(), LongType(), BinaryType()]
    schema = StructType([StructField(n, t) for n, t in zip(names, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.select(cols)
            b = b.filter(b.column(3).is_valid())
            if not b.num_rows:
                continue
            key, mark = b.column(0).to_numpy(), b.column(2).to_numpy()
            raws = _raw(b.column(1).to_pylist())
            text, _, seed, first, last = samples(raws, width)
            cut = np.searchsorted(text, np.arange(len(raws) + 1))
            keep, counts = [], []
            lists, numbers = b.column(3), b.column(4)
            for r in range(len(raws)):
                want, n = lists[r].values.to_numpy(), numbers[r].values.to_numpy()
                order = np.argsort(want)
                want, n = want[order], n[order]
                own = seed[cut[r] : cut[r + 1]]
                if not len(own) or not len(want):
                    continue
                at = np.minimum(np.searchsorted(want, own), len(want) - 1)
                hit = want[at] == own
                keep.append(np.flatnonzero(hit) + cut[r])
                counts.append(n[at[hit]])
            if not keep:
                continue
            k, n = np.concatenate(keep), np.concatenate(counts)
            salts = np.where(n > HOT, -(-n // DEAL), 1)
            spread = mix(key[text[k]].view(np.uint64) + mix(first[k].astype(np.uint64)))
            salt = (spread % salts.astype(np.uint64)).astype(np.int32)
            data = [raws[t][i : j + width] for t, i, j in zip(text[k].tolist(), first[k].tolist(), last[k].tolist(), strict=True)]
            for i in range(0, len(k), 4096):
                s = slice(i, i + 4096)
                yield pa.RecordBatch.from_arrays([pa.array(seed[k][s]), pa.array(salt[s]), pa.array(salts[s].astype(np.int32)), pa.array(key[text[k]][s]), pa.array(mark[text[k]][s]), pa.array(first[k][s]), pa.array(data[s], pa.binary())], names=names)

    return tied.mapInArrow(lean(run), schema)


def _runs(flag: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of flags within a row."""
    edge = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    begin = flag & (edge | ~np.concatenate([[False], flag[:-1]]))
    end = flag & np.concatenate([edge[1:] | ~flag[1:], [True]])
    return np.flatnonzero(begin), np.flatnonzero(end)


def _ranked(stretches: DataFrame, width: int) -> DataFrame:
    """Intervals (key, mark, start, end) of windows that are not the first of their part, and, of dealt positions, the first ones as (window, key, mark, start)."""
    names = ["key", "mark", "start", "end", "window"]
    schema = StructType([StructField(n, LongType()) for n in names])

    def solve(t: pa.Table) -> pa.RecordBatch:
        key, mark, start = (t.column(c).to_numpy() for c in ("key", "mark", "start"))
        salts = t.column("salts").to_numpy()
        data = t.column("bytes").combine_chunks()
        data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
        offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
        b = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        n = np.diff(offsets) - width + 1
        row = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = offsets[:-1][row] + inside
        h, down = prefix_hashes(b)
        w = mix((h[at + width] - h[at]) * down[at])
        part = w ^ mix(t.column("salt").to_numpy().astype(np.uint64))[row]  # the parts of a position are ranked apart
        order = np.argsort(part, kind="stable")  # rows of a part come by id and start, so the first of equals is the earliest
        lead = np.concatenate([[True], part[order][1:] != part[order][:-1]])
        first = np.empty(len(w), np.int64)
        first[order] = order[np.maximum.accumulate(np.where(lead, np.arange(len(w)), 0))]
        place = start[row] + inside
        later = (key[row] != key[row[first]]) | (place != place[first])
        i, j = _runs(later, row)
        hot = np.flatnonzero((salts[row] > 1) & (first == np.arange(len(w))))
        cols = [np.concatenate([key[row[i]], key[row[hot]]]), np.concatenate([mark[row[i]], mark[row[hot]]]), np.concatenate([place[i], place[hot]]), np.concatenate([place[j] + width, place[hot] + width])]
        window = pa.array(np.concatenate([np.zeros(len(i), np.int64), w[hot].view(np.int64)]), pa.int64(), mask=np.concatenate([np.ones(len(i), bool), np.zeros(len(hot), bool)]))
        return pa.RecordBatch.from_arrays([*[pa.array(c) for c in cols], window], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.column("bytes").nbytes
            if size < STRETCHES:
                continue
            t = pa.Table.from_batches(held)
            seed, salt = t.column("seed").to_numpy(), t.column("salt").to_numpy()
            cut = int(np.flatnonzero((seed == seed[-1]) & (salt == salt[-1]))[0])  # the last position may go on
            if cut:
                yield solve(t.slice(0, cut))
            held = t.slice(cut).to_batches()
            size = sum(x.column("bytes").nbytes for x in held)
        if held:
            yield solve(pa.Table.from_batches(held))

    n = shuffle_width(stretches.sparkSession)
    dealt = stretches.repartition(n, "seed", "salt").sortWithinPartitions("seed", "salt", "key", "start")
    return dealt.mapInArrow(lean(run), schema)


def _last(ranked: DataFrame) -> DataFrame:
    """Intervals of the first windows of parts that another part has earlier."""
    schema = StructType([StructField(n, LongType()) for n in ("key", "mark", "start", "end")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (None, None, None)
        for b in batches:
            window, key, start = (b.column(c).to_pylist() for c in ("window", "key", "start"))
            keep = []
            for w, k, s in zip(window, key, start, strict=True):
                if w != seen[0]:
                    seen = (w, k, s)
                keep.append((k, s) != seen[1:])
            yield b.select(["key", "mark", "start", "end"]).filter(pa.array(keep, pa.bool_()))

    hot = ranked.where("window is not null")
    return hot.repartition(shuffle_width(ranked.sparkSession), "window").sortWithinPartitions("window", "key", "start").select("key", "mark", "start", "end", "window").mapInArrow(lean(run), schema)


def _copies(scratch: Scratch, rows: DataFrame, width: int) -> DataFrame:
    """(key, mark, size) of the texts that stand whole under a lesser id: all of one goes, and its windows need no ranking."""
    least = rows.where(F.col("size") >= width).groupBy("mark", "other", "size").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").drop("hi")
    return scratch.save(rows.join(least, ["mark", "other", "size"]).where("key > lo").select("key", "mark", "size").distinct())


def remove_repeats(df: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """Append ``kept`` (the remaining bytes), ``n_bytes``, ``n_removed`` and ``removed`` (maximal runs of removed bytes as start, end) to every row.

    ``as_text``: ``kept`` is a text instead (null for null), without the bytes that are no whole character any more.
    """
    if width < 2 * SEED:
        raise ValueError(f"width must be {2 * SEED} at least")
    spark = df.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "repeats")
    text = F.col(f"`{text_col}`")
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL_ID)).alias("key")
    mark = F.xxhash64(text).alias("mark")
    seeds = scratch.save(_seeds(df.select(key, mark, text.alias("text")), width))
    every = seeds.select(F.explode(F.arrays_zip("seeds", "counts")).alias("x")).select(F.col("x.seeds").alias("seed"), F.col("x.counts").alias("n"))
    tied = scratch.save(every.groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1"))
    scratch.release()
    lists = seeds.select("key", "mark", F.explode("seeds").alias("seed")).join(tied, "seed").groupBy("key", "mark").agg(F.collect_set(F.struct("seed", "n")).alias("s"))
    copies = _copies(scratch, df.select(key, mark, F.xxhash64(F.lit(1), text).alias("other"), F.octet_length(text).alias("size")), width)
    lists = scratch.save(lists.join(copies, ["key", "mark"], "left_anti").select("key", "mark", F.col("s.seed").alias("seeds"), F.col("s.n").alias("counts")))
    scratch.drop(seeds)
    scratch.drop(tied)
    scratch.release()
    names = fresh(df, "kept", "n_bytes", "n_removed", "removed")
    own_key, own_mark, want, counts, cuts = fresh(df, "cut_key", "cut_mark", "cut_seeds", "cut_counts", "cuts")
    rows = df.withColumn(own_key, key).withColumn(own_mark, mark)
    asked = rows.join(lists.select(F.col("key").alias(own_key), F.col("mark").alias(own_mark), F.col("seeds").alias(want), F.col("counts").alias(counts)), [own_key, own_mark], "left")
    ranked = scratch.save(_ranked(_stretches(asked, [own_key, text_col, own_mark, want, counts], width), width))
    scratch.drop(lists)
    del asked
    scratch.release()
    found = ranked.where("window is null").drop("window").unionByName(_last(ranked))
    found = found.unionByName(copies.select("key", "mark", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end")))
    found = found.select(F.col("key").alias(own_key), F.col("mark").alias(own_mark), F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).alias("cut"))
    per_row = found.groupBy(own_key, own_mark).agg(F.collect_list("cut").alias(cuts))
    rows = rows.join(per_row, [own_key, own_mark], "left").select(*[F.col(f"`{c}`") for c in df.columns], cuts)
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([*df.schema.fields, StructField(names[0], StringType() if as_text else BinaryType()), StructField(names[1], LongType()), StructField(names[2], LongType()), StructField(names[3], ArrayType(span))])
    where = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            kept, size, gone, spans = [], [], [], []
            texts = b.column(where).to_pylist()
            for t, raw, of_row in zip(texts, _raw(texts), b.column(b.num_columns - 1), strict=True):
                size.append(len(raw))
                if not of_row.is_valid:
                    kept.append(t if as_text else raw), gone.append(0), spans.append([])
                    continue
                change = np.zeros(len(raw) + 1, np.int64)
                np.add.at(change, of_row.values.field("start").to_numpy(), 1)
                np.add.at(change, of_row.values.field("end").to_numpy(), -1)
                out = np.cumsum(change)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                left = np.frombuffer(raw, np.uint8)[~out].tobytes()
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                gone.append(int(out.sum()))
                spans.append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind)], names=schema.names)

    return rows.mapInArrow(lean(run), schema)
