"""Chat formatting by token-level assembly.

The roles and texts of a conversation's turns are encoded segment by segment, and reserved ids beyond the vocabulary are
spliced in around them: open, role, says, text, close. No text can forge a reserved id, because segments
are encoded apart and special tokens of the vocabulary count as plain text. For the written form, control strings inside a
text get a backslash before them and backslashes are doubled, so the written form can be read back as well.

Lengths of segments summed up along a conversation give each turn's place and its runs of trained
tokens (the loss mask). Turns are sorted by range partitions of (conversation, turn), so a conversation with a third of all rows spreads
over many tasks. A task sums within its partition; one row per partition reaches the driver, which adds up what conversations carry over a boundary.

Defined results: a null text or role counts as empty; a null conversation id is a conversation of its own; turns are ordered by
turn (null first), role, then a hash of the text, and repeated rows are turns of their own. An empty table
gives no rows. Other columns are carried; where a result's name clashes, it gets a leading underscore.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .runtime import Scratch, fresh, lean, prepare, shuffle_width

#: The written forms of the reserved ids, which follow the vocabulary's own in this order.
OPEN, SAYS, CLOSE = CONTROLS = ("<turn>", "<says>", "</turn>")
TRAINED = ("assistant",)
#: What a turn's row gets: its number, its ids, and its place, length and trained run in the conversation, in tokens and in code points of the written form.
ADDED = ("place", "ids", "token_start", "n_tokens", "loss_start", "loss_end", "char_start", "n_chars")
SUMMED = ("place", "token_start", "loss_start", "loss_end", "char_start")


#: White space in a row from which on texts are encoded without the ranks, whose matcher runs on a bounded stack.
LONG_BLANK = re.compile(r"\s{10000}")


class Template:
    """Encodes, decodes, escapes and reads turns with one byte-level vocabulary. ``ranks`` names the same vocabulary as ranks and ``pattern`` how it parts texts: they give the same ids, sooner."""

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(vocabulary)
        self.coder.no_truncation()
        self.coder.no_padding()
        self.coder.encode_special_tokens = True
        self.by_ranks = None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
            self.by_ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        size = self.coder.get_vocab_size(with_added_tokens=True)
        self.open, self.says, self.close = self.reserved = (size, size + 1, size + 2)
        strings = [*CONTROLS, *sorted(x.content for x in self.coder.get_added_tokens_decoder().values())]
        either = "|".join(map(re.escape, sorted(strings, key=len, reverse=True)))
        self._roles = lru_cache(maxsize=64)(self.decode)
        self._escape, self._unescape = re.compile(rf"\\|{either}"), re.compile(rf"\\(\\|{either})")

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return self._unescape.sub(lambda m: m[1], text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.by_ranks is None:
            return [x.ids for x in self.coder.encode_batch(texts, add_special_tokens=False)]
        return [self.coder.encode(t, add_special_tokens=False).ids if LONG_BLANK.search(t) else self.by_ranks.encode_ordinary(t) for t in texts]

    def decode(self, ids: Sequence[int]) -> str:
        return self.coder.decode(ids, skip_special_tokens=False)

    def turn(self, ids: list[int], lo: int, hi: int) -> tuple[str, str, int, str | None]:
        """Role, text, code points of the written form, and the text of the ids from ``lo`` to before ``hi`` (None if there are none) of a turn."""
        says, close = ids.index(self.says), len(ids) - 1
        if ids[0] != self.open or ids[close] != self.close:
            raise ValueError("a turn does not lie between its reserved ids")
        role, text = self._roles(tuple(ids[1:says])), self.decode(ids[says + 1 : close])
        plain = self.unescape(text)
        masked = None if hi <= lo else plain if (lo, hi) == (says + 1, close) else self.unescape(self.decode(ids[lo:hi]))
        return self.unescape(role), plain, len(OPEN) + len(role) + len(SAYS) + len(text) + len(CLOSE), masked


@lru_cache(maxsize=2)
def template(vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> Template:
    return Template(vocabulary, ranks, pattern)


def _same(a: object, b: object) -> bool:
    return a == b or (a != a and b != b)  # NaN is one key, as in Spark


def format_turns(df: DataFrame, vocabulary: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: tuple[str, ...] = TRAINED, keep: list[str] | None = None, ranks: str | None = None, pattern: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per turn: ``keep`` (default: all columns; the conversation always) and the columns ADDED.

    ``ids`` are little-endian unsigned 32-bit integers; a conversation's sequence is its turns' ids in the order of ``place``.
    Tokens from ``loss_start`` to before ``loss_end`` are trained: the text of the ``trained`` roles, nothing else.
    """
    spark = df.sparkSession
    prepare(spark)
    scratch = scratch or Scratch(spark, "chat")
    kept = list(df.columns) if keep is None else list(dict.fromkeys([conv_col, *keep]))
    held = df.select(*[F.col(f"`{c}`") for c in kept])
    names = dict(zip(ADDED, fresh(held, *ADDED), strict=True))
    role, text, tie, salt, mark = fresh(held, "said_by", "said", "tie", "salt", "mark")
    conv, turn = F.col(f"`{conv_col}`"), fresh(held, "turn_order")[0]
    rows = df.select(*held.columns, F.col(f"`{turn_col}`").alias(turn), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias(role), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text))
    rows = rows.withColumn(tie, F.xxhash64(text)).withColumn(salt, F.monotonically_increasing_id())  # the salt parts repeated rows
    order = [conv, F.col(turn), F.col(role), F.col(tie), F.col(salt)]
    inner = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).drop(turn, tie, salt).withColumn(mark, F.monotonically_increasing_id())
    kinds = [BinaryType() if a == "ids" else LongType() for a in ADDED]
    schema = StructType([*held.schema.fields, StructField(mark, LongType()), *[StructField(names[a], k) for a, k in zip(ADDED, kinds, strict=True)]])
    width, key = len(held.columns), held.columns.index(conv_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, last, begun = template(vocabulary, ranks, pattern), None, False
        place = tokens = chars = 0
        for b in batches:
            roles, texts = b.column(width).to_pylist(), [t.escape(x) for x in b.column(width + 1).to_pylist()]
            by = {r: (t.escape(r), x) for r, x in zip(dict.fromkeys(roles), t.encode([t.escape(r) for r in dict.fromkeys(roles)]), strict=True)}
            said = t.encode(texts)
            # lengths of open, role, says, text, close; their running sums are where each begins
            lengths = np.array([[1, len(by[r][1]), 1, len(s), 1] for r, s in zip(roles, said, strict=True)], np.int64).reshape(-1, 5)
            ends = lengths.cumsum().reshape(-1, 5)
            written = np.array([len(OPEN + by[r][0] + SAYS + x + CLOSE) for r, x in zip(roles, texts, strict=True)], np.int64)
            done = written.cumsum()
            n = len(roles)
            news = np.zeros(n, bool)
            for i, k in enumerate(b.column(key).to_pylist()):
                news[i] = begun and not _same(k, last)
                last, begun = k, True
            # what stands before each row's conversation: nothing, or (before the first new one) less than nothing: what earlier batches hold
            first = np.maximum.accumulate(np.where(news, np.arange(n), -1))
            at = np.maximum(first, 0)
            before = lambda sums, own, carried: np.where(first >= 0, sums[at] - own[at], -carried)
            size = lengths.sum(axis=1)
            start = ends[:, 4] - size - before(ends[:, 4], size, tokens)
            char = done - written - before(done, written, chars)
            number = np.arange(n) - np.where(first >= 0, first, -place)
            loss = np.array([r in trained for r in roles], bool)
            loss_start = start + lengths[:, :3].sum(axis=1)
            cols = {"place": number, "token_start": start, "n_tokens": size, "loss_start": loss_start, "loss_end": loss_start + np.where(loss, lengths[:, 3], 0), "char_start": char, "n_chars": written}
            ids = [np.array([t.open, *by[r][1], t.says, *s, t.close], "<u4").tobytes() for r, s in zip(roles, said, strict=True)]
            if n:
                place, tokens, chars = int(number[-1]) + 1, int(start[-1] + size[-1]), int(char[-1] + written[-1])
            yield pa.RecordBatch.from_arrays([*b.columns[:width], b.column(width + 2), *[pa.array(ids, pa.binary()) if a == "ids" else pa.array(cols[a], pa.int64()) for a in ADDED]], names=schema.names)

    made = scratch.save(inner.mapInArrow(lean(run), schema))
    part = F.shiftright(mark, 33)
    end = F.struct(conv.alias("conv"), (F.col(names["place"]) + 1).alias("place"), (F.col(names["token_start"]) + F.col(names["n_tokens"])).alias("tokens"), (F.col(names["char_start"]) + F.col(names["n_chars"])).alias("chars"))
    edges = made.groupBy(part.alias("part")).agg(F.min_by(F.struct(conv.alias("conv")), mark).alias("first"), F.max_by(end, mark).alias("last")).orderBy("part").collect()  # one row per partition
    carried, before = [], None
    for e in edges:
        sums = (0, 0, 0)
        if before is not None and _same(before[0], e.first.conv):
            sums = before[1]
            carried.append((e.part, *sums))
        whole = _same(e.first.conv, e.last.conv)
        before = (e.last.conv, tuple(x + y * whole for x, y in zip((e.last.place, e.last.tokens, e.last.chars), sums, strict=True)))
    out = made
    if carried:
        # at most one conversation reaches into a partition: its first
        reach = {e.part: e.first.conv for e in edges}
        over = spark.createDataFrame([(reach[p], p, *s) for p, *s in carried], StructType([StructField("conv", held.schema[key].dataType), *[StructField(n, LongType()) for n in ("part", "place", "tokens", "chars")]]))
        more = dict(zip(("conv", "part", "place", "tokens", "chars"), fresh(made, "over_conv", "over_part", "over_place", "over_tokens", "over_chars"), strict=True))
        over = over.select(*[F.col(k).alias(v) for k, v in more.items()])
        out = made.join(F.broadcast(over), (part == F.col(more["part"])) & conv.eqNullSafe(F.col(more["conv"])), "left")  # one row per partition at most
        plus = {"place": "place", "token_start": "tokens", "loss_start": "tokens", "loss_end": "tokens", "char_start": "chars"}
        out = out.withColumns({names[a]: F.col(names[a]) + F.coalesce(F.col(more[plus[a]]), F.lit(0)) for a in SUMMED})
    return out.select(*held.columns, *[names[a] for a in ADDED])


def read_turns(made: DataFrame, vocabulary: str, conv_col: str = "conv_id") -> DataFrame:
    """What ids and mask of ``format_turns`` say: conversation, place, role, text, code points of the written form, and the text under the mask (null if the mask is empty)."""
    prepare(made.sparkSession)
    names = dict(zip(ADDED, made.columns[-len(ADDED) :], strict=True))
    read = made.select(F.col(f"`{conv_col}`").alias("conv"), *[F.col(names[a]).alias(a) for a in ("place", "ids", "token_start", "loss_start", "loss_end")])
    schema = StructType([read.schema["conv"], StructField("place", LongType()), StructField("role", StringType()), StructField("text", StringType()), StructField("n_chars", LongType()), StructField("trained", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = template(vocabulary)
        for b in batches:
            rows = []
            for ids, start, lo, hi in zip(*[b.column(i).to_pylist() for i in range(2, 6)], strict=True):
                rows.append(t.turn(np.frombuffer(ids, "<u4").tolist(), lo - start, hi - start))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]], names=schema.names)

    return read.mapInArrow(lean(run), schema)


def digest_turns(turns: DataFrame) -> DataFrame:
    """Per conversation: number of turns, and digests of what ``read_turns`` gives. A digest runs over a conversation in order, so one task takes it, turn by turn."""
    prepare(turns.sparkSession)
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    schema = StructType([turns.schema["conv"], *[StructField(n, StringType() if n.endswith("sha256") else LongType()) for n in names]])
    dealt = turns.repartition(shuffle_width(turns.sparkSession), "conv").sortWithinPartitions("conv", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = None, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], names=schema.names)

        def ended() -> tuple:
            return (last, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4])

        fields = None
        for b in batches:
            rows = []
            fields = [b.schema.field(0), *[pa.field(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names]]
            for conv, role, text, n, trained in zip(*[b.column(i).to_pylist() for i in (0, 2, 3, 4, 5)], strict=True):
                if now is None or not _same(conv, last):
                    if now is not None:
                        rows.append(ended())
                    last, now = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[0] += 1
                now[1].update(f"{role}\n{text}\n".encode())
                if trained is not None:
                    now[2] += len(trained)
                    now[3].update(trained.encode())
                now[4] += n
            yield batch(rows)
        if now is not None:
            yield batch([ended()])

    return dealt.mapInArrow(lean(run), schema)
