"""BPE encoding and decoding with reuse of content-defined chunks.

A document is cut where a rolling hash of its last 32 bytes has its upper bits at zero, so equal
passages are cut alike wherever they stand. Documents are dealt into batches by a hash, and every
batch names its distinct chunks by a 128-bit hash. A chunk that several batches name is shared: the
least of them encodes it, and a join on the hash brings the ids to the others, so a chunk is encoded
once across documents. Only hashes and the ids of shared chunks are joined; a batch encodes its own
chunks, each once, itself. A cut may fall inside a word: the join is repaired by re-encoding the stretch
around it, which grows over further chunks until white space bounds it on both sides. There both sides
agree with the encoding of the whole text, because the tokenizer drops white space and no rule of it
looks across white space. Decoding does each distinct run of ids of a batch once.

Below the chunks works ``Encoder``: whole batches of text become arrays of pieces (runs of letters
or punctuation, single digits), pieces are looked up by a 64-bit hash in a direct-mapped table, and
only pieces that the table lacks run through the merges, many at a time. Words with other bytes
than ASCII and Latin-1 letters (or with an apostrophe or ``<``) go to the tokenizers library whole.

Defined results: a null or empty text has no ids and decodes to an empty text. Rows stay one to one, in
no order, whatever ids repeat or are null. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, LongType, MapType, StringType, StructField, StructType, VariantType

from .runtime import Scratch, fresh, lean, prepare, shuffle_width, trim

#: Bounds of what a Python worker keeps; a full table is emptied, which changes no result.
SLOT_BITS, POOL_IDS = 19, 3_000_000
#: Bytes of text in a batch of documents (on average).
BATCH_BYTES = 4 << 20
#: Bytes that the encoder works on at once (a longer text is worked on whole), and letters of the longest piece merged here.
BLOCK, LONGEST = 1 << 18, 48
#: Upper bits of the rolling hash that must be zero at a cut: 2**10 bytes between cuts on average.
CUT_BITS = 10
_WHITE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_SPACES = b"\t\n\x0b\x0c\r "
_rng = np.random.default_rng(20_481)
_GEAR = _rng.integers(0, 2**32, 256, dtype=np.uint32)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_NEVER = np.int32(1 << 30)


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    for c in range(33, 127):
        out[c] = _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _MARK
    out[list(_SPACES)] = _WHITE
    out[list(b"'<")] = _OTHER
    out[0xC3] = _LETTER  # leads U+00C0 to U+00FF, all letters but two
    out[0x80:0xC0] = _LETTER
    return out


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, as far as needed."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), BLOCK + 4096)
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
                p = np.full(size, np.uint64(b))
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down


class Encoder:
    """Exact encoder of a tokenizer that drops white space between words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        model = spec["model"]
        if not any(s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") for s in steps) or model.get("end_of_word_suffix") != "</w>":
            raise ValueError("a tokenizer that drops white space and marks the ends of words is needed")
        if spec.get("post_processor") or spec.get("decoder"):
            raise ValueError("a tokenizer without post-processor and decoder is needed")
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.texts = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        vocab, merges = model["vocab"], model["merges"]
        pairs = np.array([(vocab[a] << 32 | vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(tuple(m) if isinstance(m, list) else m.split(" ") for m in merges)], np.int64)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.made = pairs[np.argsort(pairs[:, 1]), 2].astype(np.int32)  # by rank
        self.pair, self.rank = pairs[:, 0].copy(), pairs[:, 1].astype(np.int32)
        names = _byte_names()
        self.inside = np.array([vocab.get(c, -1) for c in names], np.int32)
        self.last = np.array([vocab.get(c + "</w>", -1) for c in names], np.int32)
        self.powers = Powers(_BASE)
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(1 << SLOT_BITS, np.uint64)
        self.at = np.zeros(1 << SLOT_BITS, np.int32)
        self.size = np.zeros(1 << SLOT_BITS, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _add(self, ids: np.ndarray) -> int:
        start, end = self.used, self.used + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[start:end] = ids
        self.used = end
        return start

    # -- pieces that the table lacks

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left.astype(np.int64) << 32 | right
        i = np.minimum(np.searchsorted(self.pair, want), len(self.pair) - 1)
        return np.where((self.pair[i] == want) & (right >= 0), self.rank[i], _NEVER)

    def merge(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces raw[start:start+length] one after the other, and their numbers: the pair of least rank, leftmost first, is merged in all pieces at once, until none has a pair left."""
        order = np.argsort(length, kind="stable")
        out_ids, out_n = [], np.zeros(len(start), np.int64)
        for rows in np.array_split(order, max(1, len(order) // 2048)):
            n, width = length[rows], int(length[rows].max())
            col = np.arange(width)
            s = np.where(col < n[:, None], self.inside[raw[np.minimum(start[rows][:, None] + col, len(raw) - 1)]], np.int32(-1))
            s[np.arange(len(rows)), n - 1] = self.last[raw[start[rows] + n - 1]]
            s = np.concatenate([s, np.full((len(rows), 1), -1, np.int32)], axis=1)
            done, live = np.full_like(s, -1), np.arange(len(rows))
            r = self._ranks(s[:, :-1], s[:, 1:])
            while len(live):
                k, best = np.arange(len(live)), r.argmin(axis=1)
                more = r[k, best] < _NEVER
                if not more.all():
                    done[live[~more], : s.shape[1]] = s[~more]
                    live, s, r, best = live[more], s[more], r[more], best[more]
                    k = np.arange(len(live))
                    if not len(live):
                        break
                s[k, best] = self.made[r[k, best]]
                later = np.arange(r.shape[1]) > best[:, None]
                s = np.concatenate([s[:, :1], np.where(later, s[:, 1:], s[:, :-1])[:, 1:], np.full((len(live), 1), -1, np.int32)], axis=1) if r.shape[1] == 1 else np.where(later, s[:, 1:], s[:, :-1])
                if r.shape[1] > 1:
                    r = np.where(later[:, 1:] | (np.arange(1, r.shape[1]) == best[:, None]), r[:, 1:], r[:, :-1])[:, : s.shape[1] - 1]
                for at in (np.minimum(best, r.shape[1] - 1), np.maximum(best - 1, 0)):
                    r[k, at] = self._ranks(s[k, at], s[k, at + 1])
            out_ids.append(done[done >= 0])
            out_n[rows] = (done >= 0).sum(axis=1)
        flat = np.concatenate(out_ids) if out_ids else np.zeros(0, np.int64)
        ends = np.cumsum(out_n[order])  # flat follows order; bring it back to the order of the pieces
        begin = np.zeros(len(order), np.int64)
        begin[order] = ends - out_n[order]
        take = np.repeat(begin - (np.cumsum(out_n) - out_n), out_n) + np.arange(int(out_n.sum()))
        return flat[take].astype(np.uint32), out_n

    # -- blocks of text

    def _block(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the pieces of a block that begins and ends with white space, where their ids stand in the pool, and how many."""
        b = np.frombuffer(raw, np.uint8)
        kind, low = _CLASS[b], _LOWER[b]
        lead = np.flatnonzero(b[:-1] == 0xC3) + 1
        if len(lead):
            after = b[lead]
            low[lead[(after < 0x9F) & (after != 0x97)]] += 32
            kind[lead[(after == 0x97) | (after == 0xB7)]] = _OTHER
        change = kind[1:] != kind[:-1]
        first = change | (kind[1:] == _DIGIT)
        first &= kind[1:] != _WHITE
        start = np.flatnonzero(first) + 1
        final = change | (kind[:-1] == _DIGIT)
        final &= kind[:-1] != _WHITE
        end = np.flatnonzero(final) + 1
        odd = np.flatnonzero(kind == _OTHER)
        whole = np.zeros(len(start), bool)
        if len(odd):  # words with other bytes are one piece each
            white = np.flatnonzero(kind == _WHITE)
            w = np.unique(np.searchsorted(white, odd))
            ws, we = white[w - 1] + 1, white[w]
            inside = np.searchsorted(ws, start, side="right") - 1
            plain = ~((inside >= 0) & (start < we[np.maximum(inside, 0)]))
            start, end = np.concatenate([start[plain], ws]), np.concatenate([end[plain], we])
            whole = np.concatenate([np.zeros(int(plain.sum()), bool), np.ones(len(ws), bool)])
            order = np.argsort(start, kind="stable")
            start, end, whole = start[order], end[order], whole[order]
        up, down = self.powers.to(len(b) + 1)
        h = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[low] * up[: len(b)], out=h[1:])
        h = (h[end] - h[start]) * down[start]
        if len(odd):  # the library sees these in their own case
            g = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(_BYTE[b] * up[: len(b)], out=g[1:])
            h = np.where(whole, ((g[end] - g[start]) * down[start]) ^ _MIX, h)
        h = (h ^ (h >> np.uint64(29))) * _MIX | np.uint64(1)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, size = self.at[slot], self.size[slot]
        lacks = np.flatnonzero(self.key[slot] != h)
        if len(lacks):
            one, where, back = np.unique(h[lacks], return_index=True, return_inverse=True)
            where = lacks[where]
            s, n = start[where], end[where] - start[where]
            own = ~whole[where] & (n <= LONGEST)
            new_at, new_size = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
            if own.any():
                ids, count = self.merge(low, s[own], n[own])
                base = self._add(ids)
                new_at[own], new_size[own] = base + np.cumsum(count) - count, count
            ask = np.flatnonzero(~own)
            if len(ask):
                some = [raw[i : i + k].decode("utf-8", "surrogatepass") for i, k in zip(s[ask].tolist(), n[ask].tolist(), strict=True)]
                for j, e in zip(ask.tolist(), self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                    new_at[j], new_size[j] = self._add(np.array(e.ids, np.uint32)), len(e.ids)
            at[lacks], size[lacks] = new_at[back], new_size[back]
            hold = slot[where]
            self.key[hold], self.at[hold], self.size[hold] = one, new_at, new_size
        return start, at, size

    def encode_raw(self, raws: list[bytes]) -> list[bytes]:
        """Ids of each text (UTF-8 bytes) as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        i = 0
        while i < len(raws):
            j, n = i, 0
            while j < len(raws) and (j == i or n + len(raws[j]) < BLOCK):
                n += len(raws[j]) + 1
                j += 1
            if self.used > POOL_IDS:
                self.clear()
            start, at, size = self._block(b"\n" + b"\n".join(raws[i:j]) + b"\n")
            sums = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size, out=sums[1:])
            ids = self.pool[np.repeat(at - sums[:-1], size) + np.arange(sums[-1])]
            bounds = np.cumsum([1] + [len(r) + 1 for r in raws[i:j]])
            cut = sums[np.searchsorted(start, bounds)].tolist()
            flat = ids.astype("<u4").tobytes()
            out += [flat[4 * x : 4 * y] for x, y in zip(cut, cut[1:], strict=False)]
            i = j
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_raw([t.encode("utf-8", "surrogatepass") for t in texts])

    def encode_chunked(self, cut: list[list[bytes]], known: dict[bytes, bytes]) -> list[list[bytes]]:
        """Runs of ids that make up each text, given its chunks and the ids inside those that are ``known``; every other chunk is encoded once."""
        entries = {c: bounds(c) for cs in cut for c in cs}
        new = [c for c, e in entries.items() if e and c not in known]
        inside = known | dict(zip(new, self.encode_raw([inner(c, entries[c]) for c in new]), strict=True))
        plans: list[list] = []
        joins: dict[bytes, int] = {}
        for cs in cut:
            stretch, plan = b"", []
            for c in cs:
                entry = entries[c]
                if entry is None:  # nothing bounds the stretch yet: it grows over the whole chunk
                    stretch += c
                    continue
                if w := stretch + entry[0]:
                    plan.append(joins.setdefault(w, len(joins)))
                plan.append(inside[c])
                stretch = entry[1]
            if stretch:
                plan.append(joins.setdefault(stretch, len(joins)))
            plans.append(plan)
        mended = self.encode_raw(list(joins))
        return [[mended[p] if type(p) is int else p for p in plan] for plan in plans]

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _byte_names() -> list[str]:
    """The printable character that byte-level BPE writes for each byte: itself where printable, else the next free one from U+0100."""
    out, free = [], 256
    for c in range(256):
        if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c:
            out.append(chr(c))
        else:
            out.append(chr(free))
            free += 1
    return out


def content_chunks(raw: bytes) -> list[bytes]:
    """Cut after each byte at which the rolling hash of the last 32 bytes has CUT_BITS zero upper bits, then at the next character."""
    if len(raw) < 64:
        return [raw] if raw else []
    h = _GEAR[np.frombuffer(raw, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # h[i] covers 2 * step bytes after each round
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    cuts = [0]
    for i in (np.flatnonzero(h[31:-1] < np.uint32(1 << (32 - CUT_BITS))) + 32).tolist():
        while i < len(raw) and raw[i] & 0xC0 == 0x80:
            i += 1
        if cuts[-1] < i < len(raw):
            cuts.append(i)
    cuts.append(len(raw))
    return [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


def bounds(chunk: bytes) -> tuple[bytes, bytes] | None:
    """What stands in a chunk before its first and after its last white space; None if it has none."""
    head = b"" if chunk[0] in _SPACES else chunk.split(None, 1)[0]
    if len(head) == len(chunk):
        return None
    return head, b"" if chunk[-1] in _SPACES else chunk.rsplit(None, 1)[-1]


def inner(chunk: bytes, entry: tuple[bytes, bytes]) -> bytes:
    return chunk[len(entry[0]) : len(chunk) - len(entry[1])]


def _planes(ids: bytes) -> bytes:
    """The first bytes of all ids, then the second ones, and so on: the upper ones shrink to nothing in a shuffle."""
    return np.ascontiguousarray(np.frombuffer(ids, np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> bytes:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).tobytes()


_loaded: dict[str, Encoder] = {}


def coder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (MapType, VariantType))


def _chunked(df: DataFrame, vocabulary: str, text_col: str, keep: list[str], add: list[tuple[str, DataType, pa.DataType]], finish) -> DataFrame:
    """Append to the columns ``keep`` those that ``finish`` makes of the runs of ids of a batch's texts."""
    spark = df.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "bpe")
    rest = [c for c in dict.fromkeys(keep) if c != text_col]
    part = df.select(*[F.col(f"`{c}`") for c in (*rest, text_col)])
    batch, slot = fresh(part, "batch", "slot")
    size = int(part.select(F.sum(F.octet_length(F.col(f"`{text_col}`")).cast("long"))).first()[0] or 0)
    width = shuffle_width(spark)
    number = width * max(1, -(-size // (BATCH_BYTES * width)))  # as many batches in every partition
    spread = [F.col(f"`{f.name}`") for f in part.schema.fields if _hashable(f.dataType)]
    docs = part.withColumn(batch, F.pmod(F.xxhash64(*spread), F.lit(number)))
    named = StructType([StructField("batch", LongType()), StructField("key", BinaryType())])
    packed = StructType([*[f for f in docs.schema.fields if f.name in rest], StructField(text_col, BinaryType()), StructField(batch, LongType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = [None if t is None else squeeze.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(texts, pa.binary()), b.column(len(rest) + 1)], names=packed.names)

    def cuts(t: pa.Table) -> list[list[bytes]]:
        open_ = zstandard.ZstdDecompressor()
        return [content_chunks(open_.decompress(x)) if x else [] for x in t.column(text_col).to_pylist()]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = dict.fromkeys((k, xxhash.xxh3_128_digest(c)) for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for c in content_chunks(t.encode("utf-8", "surrogatepass")) if bounds(c))
            keys = list(zip(*found, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.binary())], names=named.names)

    def make(own: pa.Table, asked: pa.Table) -> pa.Table:
        want = {k for ks in asked.column("keys").to_pylist() for k in ks}
        chunks = {xxhash.xxh3_128_digest(c): c for cs in cuts(own) for c in cs} if want else {}
        keys = [k for k in want if k in chunks]
        ids = coder(vocabulary).encode_raw([inner(chunks[k], bounds(chunks[k])) for k in keys])
        return pa.table({"key": pa.array(keys, pa.binary()), "ids": pa.array(map(_planes, ids), pa.binary())})

    out = StructType([f for c in keep for f in part.schema.fields if f.name == c] + [StructField(n, t) for n, t, _ in add])

    def end(own: pa.Table, shared: pa.Table) -> pa.Table:
        cut = cuts(own)
        ids = dict(zip(shared.column("key").to_pylist(), shared.column("ids").to_pylist(), strict=True))
        known = {}
        for c in {c for cs in cut for c in cs} if ids else ():
            if (found := ids.get(xxhash.xxh3_128_digest(c))) is not None:
                known[c] = _from_planes(found)
        c = coder(vocabulary)
        made = dict(zip([n for n, _, _ in add], finish(c, c.encode_chunked(cut, known)), strict=True))
        kinds = {n: k for n, _, k in add}
        cols = {}
        for n in out.names:
            if n == text_col and n not in made:
                cols[n] = pa.array([None if x is None else zstandard.ZstdDecompressor().decompress(x).decode("utf-8", "surrogatepass") for x in own.column(n).to_pylist()], pa.string())
            else:
                cols[n] = pa.array(made[n], kinds[n]) if n in made else own.column(n)
        trim()
        return pa.table(cols)

    chunks = scratch.save(docs.select(F.col(f"`{text_col}`"), F.col(f"`{batch}`")).mapInArrow(lean(name), named))
    shared = scratch.save(chunks.groupBy("key").agg(F.min("batch").alias("owner"), F.max("batch").alias("last")).where("owner < last").select("key", "owner"))
    scratch.release()

    def by_slot(rows: DataFrame) -> DataFrame:
        return rows.withColumn(slot, (F.col(f"`{batch}`") % width).cast("int")).repartitionById(width, F.col(slot))

    dealt = by_slot(docs.mapInArrow(lean(pack), packed))
    owned = by_slot(shared.groupBy(F.col("owner").alias(batch)).agg(F.collect_list("key").alias("keys")))
    made = dealt.groupBy(slot, batch).cogroup(owned.groupBy(slot, batch)).applyInArrow(make, "key binary, ids binary")
    asked = chunks.distinct().join(shared.select("key"), "key", "left_semi")
    answers = by_slot(asked.join(made, "key").select(F.col("batch").alias(batch), "key", "ids"))
    return dealt.groupBy(slot, batch).cogroup(answers.groupBy(slot, batch)).applyInArrow(end, out)


def encode_documents(df: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None, ids_col: str = "ids") -> DataFrame:
    """Append the ids of every whole text as little-endian unsigned 32-bit integers (binary column ``ids_col``).

    ``keep``: columns to carry (default all). A clash of ``ids_col`` with a column of ``df`` raises ValueError.
    """
    keep = list(df.columns) if keep is None else keep
    if ids_col.lower() in {c.lower() for c in keep}:
        raise ValueError(f"{ids_col} is a column already")
    return _chunked(df, vocabulary, text_col, keep, [(ids_col, BinaryType(), pa.binary())], lambda _, runs: [[b"".join(r) for r in runs]])


def decode_documents(df: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Append the text of the ids, special tokens included; null ids give an empty text. A clash of ``out_col`` raises ValueError."""
    if out_col.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"{out_col} is a column already")
    prepare(df.sparkSession)
    schema = StructType([*df.schema.fields, StructField(out_col, StringType())])
    where = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.decode(x or b"") for x in b.column(where).to_pylist()], pa.string())], names=schema.names)

    return df.mapInArrow(lean(run), schema)


def _decoded(c: Encoder, runs: list[list[bytes]]) -> list[str]:
    """The texts of runs of ids; each distinct run is decoded once."""
    text = {x: c.decode(x) for x in {x for r in runs for x in r} if x}
    return [" ".join(text[x] for x in r if x) for r in runs]


def encode_and_decode(df: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Ids and decoded text of every text: columns ``n_tokens``, ``ids`` and ``decoded`` (with a leading underscore where they clash) beside ``keep`` (default all)."""
    keep = list(df.columns) if keep is None else keep
    names = fresh(df.select(*[F.col(f"`{c}`") for c in keep]), "n_tokens", "ids", "decoded")
    kinds = [(LongType(), pa.int64()), (BinaryType(), pa.binary()), (StringType(), pa.string())]

    def finish(c: Encoder, runs: list[list[bytes]]) -> list[list]:
        return [[sum(map(len, r)) // 4 for r in runs], [b"".join(r) for r in runs], _decoded(c, runs)]

    return _chunked(df, vocabulary, text_col, keep, [(n, t, a) for n, (t, a) in zip(names, kinds, strict=True)], finish)
