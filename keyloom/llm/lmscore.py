"""Language-model scores by stupid backoff, from n-gram counts of the whole corpus.

Documents are dealt into batches by a hash. A batch's distinct n-grams, with their counts, are
exploded into the partitions of a count table, which is partitioned by n-gram hash: one row of
packed arrays for each batch and partition (64-bit hashes and counts), as a shuffle writes one block
for each, so a frequent word is sent once per batch. A partition of the table sums its n-grams and
joins the totals back to the rows that asked. The totals meet the batch's documents, which sum the
scores of their words. Batches and partitions are as many as the bytes of the texts ask for, so none
grows with the corpus.

A document is scored on the others: its own counts are taken off. With c(.) counts in the other
documents, N their words, and a = 0.4, a word w after the words v scores c(v w) / c(v) if
c(v w) > 0, else a times what it scores after v without its first word; a word alone scores
max(c(w), 0.5) / N. v has order - 1 words, or as many as the document has before w. The document's
score is the sum of round(1e6 * log10(score)), a long, so that its value does not depend on an order
of summing.

Defined results: a null or empty text has no words and score 0; with no other document (N = 0)
every word scores 1, that is 0. Repeated rows and rows with null or equal ids are documents of their
own. Other columns than the two named are not read, so none can clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .runtime import lean, prepare, shuffle_width, trim
from .textkeys import mix, word_hashes

#: Longest n-grams counted, the factor of a step back, and the count of a word that no other document has.
ORDER, BACKOFF, UNSEEN = 2, 0.4, 0.5
#: Bytes of text in a batch, and bytes of text for each partition of the count table (on average).
BATCH_BYTES, TABLE_BYTES = 4 << 20, 16 << 20
_C = np.uint64(0xA24BAED4963EE407)


def grams(texts: list[str | None], order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Document bounds, and for n = 1 to ``order`` a hash for each word (of the n-gram that ends there) and the places that have one."""
    words, bounds = word_hashes([t or "" for t in texts])
    place = np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = [(words, np.arange(len(words)))]
    for n in range(2, order + 1):
        longer = mix(np.concatenate([words[:1], out[-1][0][:-1] * _C + words[1:]]))
        out.append((longer, np.flatnonzero(place >= n - 1)))
    return bounds, out


def scores(texts: list[str | None], totals: list[tuple[np.ndarray, np.ndarray]], total: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and score of each text; totals are (sorted hashes, counts) by n that hold all of the texts' n-grams."""
    bounds, made = grams(texts, len(totals))
    n_words = np.diff(bounds)
    doc = np.repeat(np.arange(len(texts)), n_words)
    rest = (total - n_words)[doc]
    s = before = np.zeros(0)
    for n, ((hashes, at), known) in enumerate(zip(made, totals, strict=True), 1):
        others = np.zeros(len(doc), np.int64)  # counts in other documents: the total less the own
        if len(at):
            k = np.searchsorted(known[0], hashes[at])
            _, back, own = np.unique(doc[at] * np.int64(len(known[0]) + 1) + k, return_inverse=True, return_counts=True)
            others[at] = known[1][k] - own[back]
        if n == 1:
            s = np.maximum(others, UNSEEN) / np.maximum(rest, 1)
        else:
            s[at] = np.where(others[at] > 0, others[at] / np.maximum(before[at - 1], 1), s[at] * BACKOFF)
        before = others
    s[rest == 0] = 1
    sums = np.concatenate([[0], np.cumsum(np.rint(np.log10(s) * 1e6).astype(np.int64))])
    return n_words, sums[bounds[1:]] - sums[bounds[:-1]]


def _tables(texts: list[str | None], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [np.unique(hashes[at], return_counts=True) for hashes, at in grams(texts, order)[1]]


def packed(x: np.ndarray) -> bytes:
    """64-bit integers as eight planes of bytes: planes of equal bytes shrink to nothing in a shuffle."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables that hold one whole group each of a sorted column."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        k = b.column(column).to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]])).tolist()
        for lo, hi in zip(edge, edge[1:], strict=False):
            if held and held[-1].column(column)[-1].as_py() != int(k[lo]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per row of ``df``: id, n_words, score_micro. ``order`` is the longest n-gram counted (1 at least)."""
    if order < 1:
        raise ValueError("order must be 1 at least")
    spark = df.sparkSession
    prepare(spark)
    text = F.col(f"`{text_col}`")
    count = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")
    sizes = df.select(F.octet_length(text).cast("long").alias("b"), count.alias("w")).agg(F.sum("b"), F.sum("w")).first()
    size, words = int(sizes[0] or 0), int(sizes[1] or 0)
    n = max(shuffle_width(spark), -(-size // TABLE_BYTES))
    number = n * max(1, -(-size // (BATCH_BYTES * n)))  # as many batches in every partition
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.pmod(F.xxhash64(F.col(f"`{id_col}`"), text), F.lit(number)).alias("batch"))
    slot = (F.col("batch") % n).cast("int").alias("slot")
    dealt = docs.select("*", slot).repartitionById(n, F.col("slot"))
    asked = StructType([StructField("part", IntegerType()), StructField("batch", LongType()), StructField("order", IntegerType()), StructField("hashes", BinaryType()), StructField("counts", BinaryType())])
    summed = StructType([*asked.fields[:3], StructField("totals", BinaryType())])
    kinds = pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array([(k << 64) // n for k in range(n)], np.uint64)
        for t in _groups(batches, "batch"):
            batch = t.column("batch")[0].as_py()
            out: list[list] = [[], [], [], [], []]
            for length, (h, c) in enumerate(_tables(t.column("text").to_pylist(), order), 1):
                cut = np.searchsorted(h, starts).tolist()  # hashes are sorted, so a partition's are a range of them
                for k, (i, j) in enumerate(zip(cut, [*cut[1:], len(h)], strict=True)):
                    if i < j:  # steps between sorted hashes have fewer bits than the hashes
                        steps = np.diff(h[i:j], prepend=starts[k : k + 1])
                        for own, v in zip(out, (k, batch, length, packed(steps), packed(c[i:j])), strict=True):
                            own.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=asked.names)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for t in _groups(batches, "turn"):
            hashes = [np.cumsum(unpacked(x.as_py()), dtype=np.uint64) for x in t.column("hashes")]
            counts = np.concatenate([unpacked(x.as_py()) for x in t.column("counts")])
            cut = np.cumsum([len(x) for x in hashes])[:-1]
            _, back = np.unique(np.concatenate(hashes), return_inverse=True)
            sums = np.bincount(back, weights=counts).astype(np.uint64)[back]
            # a batch knows its hashes, so their totals alone go back, in the order in which they came
            held = t.select(["part", "batch", "order"]).to_batches()
            done = 0
            parts = np.split(sums, cut)
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([packed(x) for x in parts[done : done + b.num_rows]], pa.binary())], names=summed.names)
                done += b.num_rows

    # the exploding step takes the dealt rows whole, so that their exchange is shared with the last one
    exploded = dealt.sortWithinPartitions("batch").mapInArrow(lean(explode), asked)
    turn = (F.col("part").cast("long") * (order + 1) + F.col("order")).alias("turn")
    table = exploded.repartitionById(n, F.col("part")).sortWithinPartitions("part", "order", "batch").select("*", turn)
    totals = table.mapInArrow(lean(total), summed).select("*", slot).repartitionById(n, F.col("slot"))

    def meet(own: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        texts, known = list(own["text"]), []
        for length, (hashes, _) in enumerate(_tables(texts, order), 1):
            part = sums[sums["order"] == length].sort_values("part")
            counts = [unpacked(x).astype(np.int64) for x in part["totals"]]
            known.append((hashes, np.concatenate(counts) if counts else np.zeros(0, np.int64)))
        n_words, micro = scores(texts, known, words)
        made = pd.DataFrame({"id": own["id"].astype("Int64"), "n_words": n_words, "score_micro": micro})
        trim()
        return made

    out = dealt.groupBy("slot", "batch").cogroup(totals.groupBy("slot", "batch")).applyInPandas(meet, "id long, n_words long, score_micro long")
    return out.withColumnRenamed("id", id_col)
