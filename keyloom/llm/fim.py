"""Fill-in-the-middle transformation of whole texts by bit-parallel work on big integers.

A text's UTF-8 bytes become one big integer per byte class (``bytes.translate`` to 0 and 1, read in
base 2): bit i is set if byte i is of the class. Boolean operations on such masks, shifted against
each other, mark the first byte of every unit and every place where a sentinel stands; ``bit_count`` gives the number
of units, and halving the mask again and again finds the byte at which the k-th unit begins. A text
costs time and memory in proportion to its length, and nothing is shuffled.

With n units and four numbers h1 to h4 (the first four 8-digit groups of the hex sha256 of ``seed:id``), the prefix ends after the smaller
of h1 % (n + 1) and h2 % (n + 1) units and the middle after the larger. The text stays plain if it is empty, holds a
sentinel, or h3 % 100 >= ``rate``; otherwise it is rearranged as suffix-prefix-middle if h4 % 100 < ``spm``, else prefix-suffix-middle.

Defined results: a null text counts as empty (form plain, output empty); a null id is hashed as ``seed:`` alone.
Repeated rows give equal results, rows with one id are cut by the same numbers, an empty table gives no rows. All columns of the
input are carried; where a result's name clashes, it gets a leading underscore.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .runtime import fresh, lean, prepare

PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Sentinels before prefix, suffix and middle. They begin and end with bytes that occur nowhere else in them.
SENTINELS = ("<P>", "<S>", "<M>")
#: What a text is cut into: code points, or words with the white space after them.
UNITS = ("characters", "words")


def _class(members: bytes) -> bytes:
    """A table for ``bytes.translate`` that gives 1 for the members and 0 for all others."""
    return bytes(49 if x in members else 48 for x in range(256))


_GOES_ON, _WHITE = _class(bytes(range(0x80, 0xC0))), _class(b" \t\n\v\f\r")


def mask(reverse: bytes, table: bytes) -> int:
    """The integer whose bit i tells whether byte i is of the class; ``reverse`` is the text from its last byte to its first."""
    return int(reverse.translate(table) or b"0", 2)


def unit_starts(text: bytes, units: str = "characters") -> int:
    """The mask of the bytes at which units begin. White space before the first word belongs to it."""
    reverse, all_ones = text[::-1], (1 << len(text)) - 1
    if units == "characters":
        return all_ones ^ mask(reverse, _GOES_ON)
    black = all_ones ^ mask(reverse, _WHITE)
    first = black & ~(black << 1)  # a byte that is not white after one that is
    return (first & (first - 1)) | 1 if first else int(bool(text))


def holds(text: bytes, marks: tuple[bytes, ...]) -> bool:
    """Whether one of ``marks`` occurs: the masks of its bytes, each shifted back to the mark's first byte, share a bit."""
    reverse, known = text[::-1], {}
    for m in marks:
        at = -1
        for k, x in enumerate(m):
            if x not in known:
                known[x] = mask(reverse, _class(bytes([x])))
            at &= known[x] >> k
            if not at:
                break
        if at:
            return True
    return False


def select(bits: int, k: int, width: int) -> int:
    """The place of the k-th set bit (from 0) among the lowest ``width`` bits, by halving."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        if k < (n := low.bit_count()):
            bits, width = low, half
        else:
            bits, width, at, k = bits >> half, width - half, at + half, k - n
    return at


def cut(text: bytes, h1: int, h2: int, units: str = "characters") -> tuple[int, int, int, int, int]:
    """Number of units, units of prefix and middle, and the bytes at which prefix and middle end."""
    starts = unit_starts(text, units)
    n = starts.bit_count()
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    place = lambda k: len(text) if k == n else 0 if k == 0 else select(starts, k, len(text))
    return n, a, b - a, place(a), place(b)


def numbers(seed: int, key: object) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm: int = 20, sentinels: tuple[str, str, str] = SENTINELS, units: str = "characters", keep: list[str] | None = None) -> DataFrame:
    """Append ``n_units``, ``form``, ``prefix_units``, ``middle_units`` (null if plain) and ``output`` to ``keep`` (default: all columns)."""
    if units not in UNITS:
        raise ValueError(f"units are one of {UNITS}")
    marks = tuple(s.encode() for s in sentinels)
    if len(set(marks)) < 3 or any(len(m) < 2 or m[:1] in m[1:] or m[-1:] in m[:-1] for m in marks):
        raise ValueError("sentinels must differ, and begin and end with bytes that occur nowhere else in them")
    prepare(df.sparkSession)
    held = df.select(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)])
    names = fresh(held, "n_units", "form", "prefix_units", "middle_units", "output")
    key, raw = fresh(held, "key", "raw")
    kinds = (LongType(), StringType(), LongType(), LongType(), BinaryType())
    arrow = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    schema = StructType([*held.schema.fields, *[StructField(n, k) for n, k in zip(names, kinds, strict=True)]])
    width = len(held.columns)
    read = df.select(*[F.col(f"`{c}`") for c in held.columns], F.col(f"`{id_col}`").cast("string").alias(key), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias(raw))

    def one(name: str | None, text: bytes) -> tuple:
        h1, h2, h3, h4 = numbers(seed, name)
        n, prefix, middle, a, b = cut(text, h1, h2, units)
        if not text or h3 % 100 >= rate or holds(text, marks):
            return n, PLAIN, None, None, text
        p, s, m = marks
        if h4 % 100 < spm:
            return n, SPM, prefix, middle, b"".join((s, text[b:], p, text[:a], m, text[a:b]))
        return n, PSM, prefix, middle, b"".join((p, text[:a], s, text[b:], m, text[a:b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            made = [one(i, t) for i, t in zip(x.column(width).to_pylist(), x.column(width + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*x.columns[:width], *[pa.array([r[j] for r in made], kind) for j, kind in enumerate(arrow)]], names=schema.names)

    return read.mapInArrow(lean(run), schema).withColumn(names[4], F.col(f"`{names[4]}`").cast("string"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of. No text with a sentinel was rearranged, and none arises at a joint, so an output parts at exactly three."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels))
    piece = lambda i: F.get(parts, F.lit(i))
    # psm holds prefix, suffix, middle; spm suffix, prefix, middle
    return F.when(form == PLAIN, output).when(form == PSM, F.concat(piece(1), piece(3), piece(2))).otherwise(F.concat(piece(2), piece(3), piece(1)))
