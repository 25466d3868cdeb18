"""Chroma audio fingerprints of a binary media column, and the alignment of recordings by them.

A recording (RIFF/WAVE, PCM of 8 or 16 bits) becomes pitch-class frames: windowed frames are projected
on the pitches of as many octaves as fit under half the sampling rate, and the energy is folded into
12 classes. An integral image over time and class makes every box sum four look-ups; 16 filters
compare neighbouring boxes, each is cut into 2 Gray-coded bits, and a frame's 32 bits are one integer.

Two recordings are aligned at the mode of their offset histogram (places of equal integers; of the
fullest offsets the one with fewest bit errors), and linked if the overlap there covers most of the
shorter one with few bit errors. So noisy copies, excerpts and copies with a lead-in link. A candidate
is found from its shorter side: places spread over it ask for 20 bits of their integer, as they are and
with each one turned, and any place of a recording no shorter answers if its 20 bits are the same, the
offset leaves enough overlap and the frames 4 to 48 before and after agree in most bits. At the most
bit errors that a link allows, a place finds its like with probability 0.17, and at least 16 ask. Only
the shorter fingerprint of a candidate is sent to the longer one. Bits
that many places share are dealt over several tasks by their count (at most 2^20 counts reach the
driver); a task holds one such block of answers and lets those that ask run past. Equal fingerprints
form a class that goes through as one row.

Defined results: a recording that is null, no such file, of a stated sampling rate over MOST_HZ, or
too short for an integer has none and is its own group. Silence has integers like any sound.
Recordings that overlap by fewer than LEAST_FRAMES frames (about a second) link only if their
fingerprints are equal. Rows with the same id are told apart by their fingerprints; a null id is in no
group but its own fingerprint's. Other columns than the two named are not read. An empty table gives
no rows.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from .components import components
from .runtime import Scratch, lean, prepare, shuffle_width

HOP_S, LOWEST_HZ, SPAN, STEP = 0.064, 130.8128, 8, 0.06
#: Highest sampling rate that is taken for one, and sampling rates whose projections a worker keeps.
MOST_HZ, RATES = 768_000, 16
#: Share of the shorter recording that must overlap, frames that must at least, and bit errors allowed there.
OVERLAP, LEAST_FRAMES, ERRORS = 0.6, 16, 0.15
#: Frames around an integer that are compared (16 bits of each, four frames a word), share of their bits that may differ, turns in which the integers are dealt, and offsets of a histogram that are tried.
AROUND, NEAR, TURNS, TRIED = ((4, 8, 12, 16), (20, 28, 36, 48)), 16 / 64, 4, 16
#: Bits of an integer that are looked up (the sign of every filter, both bits of four), places of a recording that ask, answers to the same bits that one task holds, pairs that are compared at once, and pairs of the same bits that are worth a table of their own.
KEY, ASKED, BLOCK, AT_ONCE, TABLE = 0xABABABAB, 32, 1 << 15, 1 << 19, 1 << 12


def samples(data: bytes | None) -> tuple[np.ndarray, int]:
    """Samples from -1 to 1 (mean of the channels) and the rate; none if the bytes are no such recording."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            rate, channels, size, raw = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0, np.float32), 0
    if not 0 < rate <= MOST_HZ:
        return np.zeros(0, np.float32), 0
    if size == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif size == 2:
        x = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / 32768
    else:
        return np.zeros(0, np.float32), 0
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1), rate


_bases: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}


def _basis(rate: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Hop, projections (cosines beside sines, windowed), and class of each pitch, for a sampling rate."""
    if rate not in _bases:
        if len(_bases) >= RATES:
            _bases.clear()
        hop = max(1, round(rate * HOP_S))
        pitches = [k for k in range(96) if LOWEST_HZ * 2 ** (k / 12) < 0.495 * rate]
        t = np.arange(2 * hop) / rate
        phase = 2 * np.pi * t[:, None] * (LOWEST_HZ * 2 ** (np.array(pitches) / 12))[None, :]
        window = np.hanning(2 * hop)[:, None]
        _bases[rate] = hop, np.hstack([np.cos(phase) * window, np.sin(phase) * window]).astype(np.float32), np.array(pitches, int) % 12
    return _bases[rate]


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """One row of 12 pitch-class shares for every hop."""
    if not rate or len(x) // max(1, round(rate * HOP_S)) < 2:
        return np.zeros((0, 12))
    hop, basis, cls = _basis(rate)
    n = len(x) // hop - 1
    if not len(cls):
        return np.zeros((0, 12))
    blocks = x[: (n + 1) * hop].reshape(n + 1, hop)
    y = blocks[:-1] @ basis[:hop] + blocks[1:] @ basis[hop:]
    power = y[:, : len(cls)] ** 2 + y[:, len(cls) :] ** 2
    out = np.zeros((n, 12))
    for c in range(12):
        out[:, c] = power[:, cls == c].sum(axis=1)
    return out / (out.sum(axis=1, keepdims=True) + 1e-6)


def fingerprint(x: np.ndarray, rate: int) -> np.ndarray:
    """Packed 32-bit integers, one for each frame that has SPAN frames from it on."""
    c = chroma(x, rate)
    n = len(c) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, 25))
    image[1:, 1:] = np.cumsum(np.cumsum(np.hstack([c, c]), axis=0), axis=1)  # classes go round

    def box(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        i = np.arange(n)
        return image[i + t1, c1] - image[i + t0, c1] - image[i + t1, c0] + image[i + t0, c0]

    code = np.zeros(n, np.uint32)
    for k in range(16):
        low, kind = 3 * (k // 4), k % 4
        if kind == 0:  # lower against upper classes
            a, b = box(0, SPAN, low, low + 3), box(0, SPAN, low + 3, low + 6)
        elif kind == 1:  # earlier against later
            a, b = box(0, SPAN // 2, low, low + 4), box(SPAN // 2, SPAN, low, low + 4)
        elif kind == 2:  # the corners of one diagonal against those of the other
            h = SPAN // 2
            a = box(0, h, low, low + 3) + box(h, SPAN, low + 3, low + 6)
            b = box(0, h, low + 3, low + 6) + box(h, SPAN, low, low + 3)
        else:  # the middle against both sides in time
            q = SPAN // 4
            a, b = box(q, 3 * q, low, low + 5), box(0, q, low, low + 5) + box(3 * q, SPAN, low, low + 5)
        v = np.log((1 + a) / (1 + b))
        level = (v > -STEP).astype(np.uint32) + (v > 0) + (v > STEP)
        code = code << np.uint32(2) | (level ^ (level >> np.uint32(1)))
    return code


def _histogram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal integers at each offset of b in a, from 1 - len(b) on. Integers with many places in both go through a transform."""
    n = len(a) + len(b) - 1
    votes = np.zeros(n, np.int64)
    _, ia, ka = np.unique(a, return_inverse=True, return_counts=True)
    ca, cb = np.unique(a), np.unique(b)
    _, ja, jb = np.intersect1d(ca, cb, assume_unique=True, return_indices=True)
    if not len(ja):
        return votes
    ib, kb = np.unique(b, return_inverse=True, return_counts=True)[1:]
    oa, ob = np.argsort(ia, kind="stable"), np.argsort(ib, kind="stable")
    sa, sb = np.cumsum(ka) - ka, np.cumsum(kb) - kb
    many = ka[ja] * kb[jb] > 16 * n
    size = 1 << n.bit_length()
    for x, y in zip(ja[many].tolist(), jb[many].tolist(), strict=True):
        u = np.fft.rfft(ia == x, size) * np.fft.rfft((ib == y)[::-1], size)
        votes += np.rint(np.fft.irfft(u, size)[:n]).astype(np.int64)
    ja, jb = ja[~many], jb[~many]
    each = ka[ja] * kb[jb]
    which = np.repeat(np.arange(len(each)), each)
    at = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
    wide = kb[jb][which]
    d = oa[sa[ja][which] + at // wide] - ob[sb[jb][which] + at % wide]
    return votes + np.bincount(d + len(b) - 1, minlength=n)


def align(a: np.ndarray, b: np.ndarray, hints: tuple[int, ...] = ()) -> tuple[int | None, float, float]:
    """Offset of b in a (frames), share of the shorter one that overlaps there, and the share of wrong bits; no offset if no integer is shared.

    Of the fullest offsets and the hints, the one with fewest wrong bits among those that overlap enough.
    """
    votes = _histogram(a, b)
    top = np.argsort(-votes, kind="stable")[:TRIED]
    best, enough = None, max(min(LEAST_FRAMES, len(a), len(b)), OVERLAP * min(len(a), len(b)))
    for d in dict.fromkeys([*(top[votes[top] > 0] - len(b) + 1).tolist(), *hints]):
        lo, hi = max(0, d), min(len(a), len(b) + d)
        if hi > lo:
            wrong = float(np.bitwise_count(a[lo:hi] ^ b[lo - d : hi - d]).sum()) / (32 * (hi - lo))
            rank = hi - lo < enough, wrong
            if best is None or rank < best[0]:
                best = rank, (d, (hi - lo) / min(len(a), len(b)), wrong)
    return best[1] if best else (None, 0.0, 1.0)


def fingerprints(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, codes): little-endian 32-bit integers of each recording."""
    prepare(df.sparkSession)
    schema = StructType([StructField("id", LongType()), StructField("codes", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [fingerprint(*samples(x.as_py())).astype("<u4").tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=schema.names)

    return df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{media_col}`")).mapInArrow(lean(run), schema)


def _aligned(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """Pairs (a, b, short, hints) with the offset of b in a, the overlap's frames and share of the shorter one, and bit errors.

    ``short``, a or b, is the one whose fingerprint is sent with every pair to the other's, which is sent once.
    """
    schema = StructType([*[StructField(c, LongType()) for c in ("a", "b", "offset", "frames")], StructField("overlap", DoubleType()), StructField("bit_errors", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for own, x, y, hints in zip(*(batch.column(c).to_pylist() for c in ("own", "codes_short", "codes_long", "hints")), strict=True):
                u, v = (np.frombuffer(c, "<u4") for c in ((x, y) if own else (y, x)))
                d, share, wrong = align(u, v, tuple(sorted(hints)))
                made.append((d, round(share * min(len(u), len(v))), share, wrong))
            cols = list(zip(*made, strict=True)) if made else [()] * 4
            kinds = pa.int64(), pa.int64(), pa.float64(), pa.float64()
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=schema.names)

    one = codes.select(F.col("id").alias("short"), F.col("codes").alias("codes_short"))
    two = codes.select(F.col("id").alias("long"), F.col("codes").alias("codes_long"))
    sent = pairs.join(one, "short").withColumn("own", F.col("short") == F.col("a")).withColumn("long", F.when(F.col("own"), F.col("b")).otherwise(F.col("a")))
    return sent.join(two, "long").select("a", "b", "own", "hints", "codes_short", "codes_long").mapInArrow(lean(run), schema)


def _around(code: np.ndarray) -> list[np.ndarray]:
    """The upper bits of the filters AROUND frames later and earlier, 16 bits of a 64-bit integer each; 0 where there is no such frame."""
    x = (code.astype(np.uint64) >> np.uint64(1)) & np.uint64(0x55555555)
    for shift, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
        x = (x | (x >> np.uint64(shift))) & np.uint64(mask)
    x = np.maximum(x, np.uint64(1))
    out = []
    for steps in AROUND:
        after, before = np.zeros(len(x), np.uint64), np.zeros(len(x), np.uint64)
        for k, step in enumerate(steps):
            after[:-step] |= x[step:] << np.uint64(16 * k)
            before[step:] |= x[:-step] << np.uint64(16 * k)
        out += [after, before]
    return out


def _rows(i: int, code: np.ndarray, turn: int, hot: np.ndarray, parts: np.ndarray) -> list[np.ndarray]:
    """Columns of the rows of a recording in a turn: what its places answer to, and what some of them ask for. ``parts``: blocks of the keys ``hot``."""

    def own(key: np.ndarray) -> np.ndarray:
        return np.flatnonzero((key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(TURNS) == turn)

    def blocks(key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        return np.where(hot[at] == key, parts[at], 1) if len(hot) else np.ones(len(key), np.int64)

    sides = _around(code)
    key = code.astype(np.uint64) & np.uint64(KEY)
    place = own(key)
    if len(place):  # equal integers in equal surroundings (silence) once
        values = np.stack([code[place].astype(np.uint64), *(v[place] for v in sides)])
        order = np.lexsort(values)
        place = place[order[np.concatenate([[True], (np.diff(values[:, order]) != 0).any(axis=0)])]]
    mixed = (place.astype(np.uint64) + np.uint64(i % (1 << 64)) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
    answers = key[place], mixed.astype(np.int64) % blocks(key[place])
    turned = np.array([0, *(1 << k for k in range(32) if KEY >> k & 1)], np.uint64)
    some = np.unique(np.linspace(0, len(code) - 1, min(len(code), ASKED)).astype(np.int64))
    asked, asks = (key[some][:, None] ^ turned).ravel(), np.repeat(some, len(turned))
    keep = own(asked)
    asked, asks = asked[keep], asks[keep]
    many = blocks(asked)  # every block of the answers is asked
    block = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    asked, asks = np.repeat(asked, many), np.repeat(asks, many)
    spot = np.concatenate([answers[0].astype(np.int64) << 31 | answers[1] << 1, asked.astype(np.int64) << 31 | block << 1 | 1])
    at = np.concatenate([place, asks])
    return [spot, np.full(len(at), i, np.int64), at.astype(np.int32), np.full(len(at), len(code), np.int32), *(v[at].view(np.int64) for v in sides)]


def _alike(spot: np.ndarray, sides: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows that ask and rows that answer to the same bits, where the nearest frames agree or are not all there (rows sorted by spot)."""
    ask, most = np.flatnonzero(spot & 1), int(64 * NEAR)
    first, last = np.searchsorted(spot, spot[ask] - 1), np.searchsorted(spot, spot[ask])
    some = last > first
    ask, first, each = ask[some], first[some], (last - first)[some]
    lacks = [v >> np.uint64(16 * (len(AROUND[0]) - 1)) == 0 for v in sides]

    def rest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = (np.bitwise_count(sides[1][a] ^ sides[1][b]) <= most) | lacks[1][a] | lacks[1][b]
        return a[near], b[near]

    start = np.flatnonzero(np.diff(first, prepend=-1))  # of those that ask for the same bits
    asks = np.diff(start, append=len(ask))
    many = asks * each[start] >= TABLE
    few = np.flatnonzero(np.repeat(~many, asks))
    for part in np.split(few, np.flatnonzero(np.diff(np.cumsum(each[few]) // AT_ONCE)) + 1):
        n = each[part]
        a = np.repeat(ask[part], n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[part], n)
        near = (np.bitwise_count(sides[0][a] ^ sides[0][b]) <= most) | lacks[0][a] | lacks[0][b]
        yield rest(a[near], b[near])
    held, size = [], 0
    for s, k in zip(start[many].tolist(), asks[many].tolist(), strict=True):  # many by many: as a table, without an index for each pair
        f, m = int(first[s]), int(each[s])
        y, lack = sides[0][f : f + m], lacks[0][f : f + m]
        step = max(1, (1 << 16) // m)
        for i in range(s, s + k, step):
            own = ask[i : min(i + step, s + k)]
            near = np.bitwise_count(sides[0][own][:, None] ^ y) <= most
            near |= lack
            near |= lacks[0][own][:, None]
            at = np.flatnonzero(near)
            held.append((own[at // m], f + at % m))
            size += len(at)
            if size >= AT_ONCE:
                yield rest(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield rest(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _meetings(spot: np.ndarray, ids: np.ndarray, place: np.ndarray, size: np.ndarray, sides: list[np.ndarray]) -> np.ndarray:
    """Distinct (a, b, offset of b in a, whether a is no longer) of recordings where one asks and the other, no shorter, answers in like surroundings, with enough overlap (rows sorted by spot)."""
    out = []
    for a, b in _alike(spot, sides[:2]):
        low, high = np.maximum(0, place[a] - place[b]), np.minimum(size[a], size[b] + place[a] - place[b])
        enough = (ids[a] != ids[b]) & (size[a] <= size[b]) & (high - low >= np.maximum(LEAST_FRAMES, OVERLAP * size[a]))
        a, b = a[enough], b[enough]
        wrong, seen = np.zeros(len(a)), np.zeros(len(a))
        for v in sides:
            for k in range(len(AROUND[0])):
                x, y = ((v[w] >> np.uint64(16 * k)) & np.uint64(0xFFFF) for w in (a, b))
                both = (x > 0) & (y > 0)
                wrong += np.bitwise_count(x ^ y) * both
                seen += 16 * both
        a, b = a[wrong <= NEAR * seen], b[wrong <= NEAR * seen]
        a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
        out.append(np.unique(np.column_stack([ids[a], ids[b], place[a] - place[b], size[a] <= size[b]]), axis=0))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 4), np.int64)


def _hot_keys(codes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys that more than BLOCK places answer to, and the number of blocks of each; a key has 20 bits, so there are at most 2^20."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n = np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4") & np.uint32(KEY), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    many = codes.select("codes").mapInArrow(lean(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK).orderBy("key").collect()
    return np.array([r.key for r in many], np.uint64), np.array([-(-r.n // BLOCK) for r in many], np.int64)


def _candidates(scratch: Scratch, codes: DataFrame) -> DataFrame:
    """(a, b, short, hints): pairs of recordings that may link, a < b, with the one of them that is no longer and offsets of b in a."""
    sides = [f"{side}_{k}" for k in range(len(AROUND)) for side in ("after", "before")]
    placed = StructType([StructField("spot", LongType()), StructField("id", LongType()), StructField("place", IntegerType()), StructField("size", IntegerType()), *[StructField(c, LongType()) for c in sides]])
    names, width, found = placed.names, shuffle_width(codes.sparkSession), None
    codes = codes.where(F.length("codes") >= 4 * LEAST_FRAMES)  # no link has fewer frames
    hot, parts = _hot_keys(codes)

    def places(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _rows(i, np.frombuffer(raw, "<u4"), turn, hot, parts)], names=names)

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(t: pa.Table) -> pa.RecordBatch:
            spot, ids, place, size, *around = (t.column(c).to_numpy() for c in names)
            out = _meetings(spot, ids, place.astype(np.int64), size.astype(np.int64), [v.view(np.uint64) for v in around])
            return pa.RecordBatch.from_arrays([*(pa.array(out[:, k]) for k in range(3)), pa.array(out[:, 3] > 0)], names=["a", "b", "offset", "no_longer"])

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 1 << 17:
                t = pa.Table.from_batches(held)
                yield made(t)
                spot = t.column("spot").to_numpy()
                last = spot[-1] & ~1  # more may ask for it: what answers stays
                t = t.slice(int(np.searchsorted(spot, last)), int(np.searchsorted(spot, last + 1) - np.searchsorted(spot, last)))
                held, rows = t.to_batches(), 0
        if rows:
            yield made(pa.Table.from_batches(held))

    for turn in range(TURNS):
        rows = codes.select("id", "codes").mapInArrow(lean(places(turn)), placed)
        part = scratch.save(rows.repartition(width, F.shiftright("spot", 1)).sortWithinPartitions("spot").mapInArrow(lean(meet), "a long, b long, offset long, no_longer boolean"))
        scratch.release()
        found = part if found is None else found.unionByName(part)
    short = F.when(F.col("no_longer"), F.col("a")).otherwise(F.col("b")).alias("short")
    return found.groupBy("a", "b", short).agg(F.collect_set("offset").alias("hints"))


def align_recordings(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """One row per recording: id, n_codes, group_id (least id of the recordings linked), and offset and bit_errors against that one."""
    spark = df.sparkSession
    scratch = Scratch(spark, "media")
    made = scratch.save(fingerprints(df, id_col, media_col).withColumn("print", F.xxhash64("codes")).withColumn("crc", F.crc32("codes")))
    some = made.where("length(codes) > 0 and id is not null")
    classes = scratch.save(some.groupBy("print", "crc").agg(F.min("id").alias("rep")))
    codes = scratch.save(some.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "codes").dropDuplicates(["id"]))
    links = _aligned(scratch.save(_candidates(scratch, codes)), codes).where((F.col("overlap") >= OVERLAP) & (F.col("frames") >= LEAST_FRAMES) & (F.col("bit_errors") <= ERRORS))
    links = scratch.save(links.select("a", "b", "offset"))
    comps = scratch.save(components(scratch, links.select("a", "b")))
    own = comps.where("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    own = own.join(links, ["a", "b"], "left").select("a", "b", F.col("b").alias("short"), F.when(F.col("offset").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("offset")).alias("hints"))
    against = scratch.save(_aligned(own, codes).select("b", "offset", "bit_errors"))
    of_class = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").join(against.withColumnRenamed("b", "rep"), "rep", "left")
    of_class = scratch.save(of_class.select("print", "crc", F.coalesce("component", "rep").alias("group_id"), F.when(F.coalesce("component", "rep") == F.col("rep"), 0).otherwise(F.col("offset")).alias("offset"), F.when(F.coalesce("component", "rep") == F.col("rep"), 0.0).otherwise(F.col("bit_errors")).alias("bit_errors")))
    n = (F.length("codes") / 4).cast("long")
    out = made.select("id", n.alias("n_codes"), F.when(F.length("codes") > 0, F.col("print")).alias("print"), "crc").join(of_class, ["print", "crc"], "left")
    return out.select(F.col("id").alias(id_col), "n_codes", F.coalesce("group_id", "id").alias("group_id"), "offset", "bit_errors")


def sonify(df: DataFrame, id_col: str, text_col: str, out_col: str = "media", rate: int = 1000) -> DataFrame:
    """(id, out_col): each text as a recording, two pitch classes a word by its hash. A stand-in for media where a table has only text."""
    prepare(df.sparkSession)
    schema = StructType([StructField(id_col, LongType()), StructField(out_col, BinaryType())])
    hop = max(1, round(rate * HOP_S))
    t = np.arange(hop) / rate
    tones = np.array([np.sin(2 * np.pi * 2 * LOWEST_HZ * 2 ** (c / 12) * t) for c in range(12)])
    notes = np.array([[np.clip(128 + 60 * (tones[i] + tones[j]), 0, 255) for j in range(12)] for i in range(12)]).astype(np.uint8).reshape(144, hop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .textkeys import word_hashes

        for b in batches:
            words, bounds = word_hashes([x or "" for x in b.column(1).to_pylist()])
            note = (words >> np.uint64(40)) % np.uint64(144)
            for i in range(b.num_rows):
                f = io.BytesIO()
                with wave.open(f, "wb") as w:
                    w.setnchannels(1), w.setsampwidth(1), w.setframerate(rate)
                    w.writeframes(notes[note[bounds[i] : bounds[i + 1]].astype(np.int64)].tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([f.getvalue()], pa.binary())], names=schema.names)

    return df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(lean(run), schema)
