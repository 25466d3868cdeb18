"""Shortest-pack-first packing of token pieces over their length histogram.

Documents become token pieces of at most ``capacity`` ids. Only the histogram of piece lengths (at
most ``capacity`` rows, whatever the input) reaches the driver, which plans packing patterns:
lengths are placed longest first, each into the shortest packs so far, by count and not by piece.
The plan then comes back to the pieces by rank: the k-th piece of a length takes the k-th place
that the patterns hold for that length.

Defined results: null and empty texts are one piece with the end id alone. Repeated rows, and rows with
null or equal ids, are packed once each. An empty table gives no rows. ``token_pieces`` reads two columns
only; ``pack`` carries all columns, and raises ValueError if ``sequence_id`` or ``offset`` is among them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .bpe import coder
from .runtime import Scratch, fresh, global_rank, lean, prepare

PLACED = ("sequence_id", "offset")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Packing patterns (how many sequences, ((length, copies), ...)) that place every piece.

    Lengths come longest first. Each goes to the shortest packs that there are; when it no longer
    fits into those it fits into none, and new packs with as many copies as fit are opened.
    """
    order, heap = count(), []
    done = []
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} ids in sequences of {capacity}")
        left = histogram[length]
        while left and heap and heap[0][0] + length <= capacity:
            used, _, n, pattern = heapq.heappop(heap)
            k = min(n, left)
            if n > k:
                heapq.heappush(heap, (used, next(order), n - k, pattern))
            if pattern[-1][0] == length:
                pattern = (*pattern[:-1], (length, pattern[-1][1] + 1))
            else:
                pattern = (*pattern, (length, 1))
            left -= k
            if used + length < capacity:
                heapq.heappush(heap, (used + length, next(order), k, pattern))
            else:
                done.append((k, pattern))
        if left:
            fit = capacity // length
            for n, copies in ((left // fit, fit), (1 if left % fit else 0, left % fit)):
                if n and copies * length < capacity:
                    heapq.heappush(heap, (copies * length, next(order), n, ((length, copies),)))
                elif n:
                    done.append((n, ((length, copies),)))
    return done + [(n, p) for _, _, n, p in heap]


def places(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> dict[str, np.ndarray]:
    """The places of each length as ranges of ranks, sorted by length and first rank. Bounded by the capacity alone."""
    rows, taken, sequence = [], {}, 0
    for n, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            base = taken.get(length, 0)
            rows.append((length, base, sequence, offset, copies))
            taken[length] = base + n * copies
            offset += length * copies
        sequence += n
    rows.sort()
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return {k: np.array(c, np.int64) for k, c in zip(("length", "base", "sequence", "offset", "copies"), cols, strict=True)}


def token_pieces(df: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the token ids of every whole text, each followed by ``end_id``: id column, start, length, doc_tokens, ids.

    ``ids`` are little-endian unsigned 32-bit integers. Every piece but the last of a document has ``capacity`` ids.
    """
    prepare(df.sparkSession)
    part = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    key = part.schema.fields[0]
    names = fresh(df.select(F.col(f"`{id_col}`")), "start", "length", "doc_tokens", "ids")
    schema = StructType([key, *[StructField(n, LongType()) for n in names[:3]], StructField(names[3], BinaryType())])
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for b in batches:
            take, start, length, total, ids = [], [], [], [], []
            for i, x in enumerate(c.encode([t or "" for t in b.column(1).to_pylist()])):
                x += end
                n = len(x) // 4
                for s in range(0, n, capacity):
                    piece = x[4 * s : 4 * (s + capacity)]
                    take.append(i)
                    start.append(s)
                    length.append(len(piece) // 4)
                    total.append(n)
                    ids.append(piece)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    return part.mapInArrow(lean(run), schema)


def pack(pieces: DataFrame, capacity: int, order: list[str], length_col: str = "length", scratch: Scratch | None = None) -> DataFrame:
    """Append ``sequence_id`` and ``offset`` to rows that have a length of 1 to ``capacity``.

    ``order`` names columns that tell the rows of a length apart; rows equal in all of them may
    swap places. All columns are carried through one range-partitioned sort.
    """
    if {c.lower() for c in pieces.columns} & set(PLACED):
        raise ValueError(f"{PLACED} are columns already")
    scratch = scratch or Scratch(pieces.sparkSession, "packing")
    kept = scratch.save(pieces)
    histogram = {int(n): int(k) for n, k in kept.groupBy(length_col).count().collect()}  # at most `capacity` rows
    at = places(plan(histogram, capacity))
    first, total = np.zeros(capacity + 2, np.int64), 0
    for n in sorted(histogram):
        first[n] = total
        total += histogram[n]
    mix, rank = fresh(kept, "mix", "rank")
    sort = [F.col(length_col), F.col(mix), *[F.col(c) for c in order]]
    ranked, raw = global_rank(scratch, kept.withColumn(mix, F.xxhash64(*order)), sort, rank)
    scratch.drop(kept)
    ranked = ranked.drop(mix)
    schema = StructType([f for f in ranked.schema.fields if f.name != rank] + [StructField(c, LongType()) for c in PLACED])
    n_at, r_at = ranked.columns.index(length_col), ranked.columns.index(rank)
    keys = at["length"] << 44 | at["base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(n_at).to_numpy()
            k = b.column(r_at).to_numpy() - first[n]
            i = np.searchsorted(keys, n << 44 | k, side="right") - 1
            t = k - at["base"][i]
            copies = at["copies"][i]
            made = [at["sequence"][i] + t // copies, at["offset"][i] + t % copies * n]
            yield pa.RecordBatch.from_arrays([c for j, c in enumerate(b.columns) if j != r_at] + [pa.array(x, pa.int64()) for x in made], names=schema.names)

    return ranked.mapInArrow(lean(run), schema)
