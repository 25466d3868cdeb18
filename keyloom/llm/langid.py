"""Language identification by blended-spectrum string kernels.

A text is the set of its letter n-grams (n = 1 to 3, presence only; a run of letters is bounded by
one space on each side), with code points folded to lower case. n-grams are told apart by a hash of
SLOT_BITS bits. k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|). A bounded sample of labelled
documents is the training set, its first rows are the Nystroem landmarks, and one-versus-rest kernel
ridge regression gives the weights. As k(x, l) is a product of presence vectors, the landmark weights
fold into one weight per n-gram and language, and a batch of texts is scored by one matrix product;
the scores are those of the kernel expansion.

The sample holds at most PER_LANGUAGE different texts of every label, and SAMPLE in all: no label is
left out, but with more than SAMPLE / PER_LANGUAGE of them each has fewer texts. A column with more
than SAMPLE different values names no languages, and raises ValueError.

Defined results: a null text, or one without letters, is ``und`` with score 0. If nothing is
labelled, every text is ``und``. Equal texts get equal results, whatever their ids; null and repeated
ids change nothing, since the sample is drawn by a hash of the text. Added columns take a leading
underscore where they clash. An empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .runtime import fresh, lean, prepare

#: Labelled texts per language and in all that the classifier is fitted on at most (the bounds of the sample), landmarks of them, and ridge.
PER_LANGUAGE, SAMPLE, LANDMARKS, RIDGE = 400, 40_000, 96, 1e-3
#: n-grams are hashed to so many bits; code point 0 is the bound of a run.
SLOT_BITS = 20
SPACE = 1 << SLOT_BITS
_SHIFT, _HALF = np.uint32(32 - SLOT_BITS), np.uint32(15)
_ONE, _TWO, _THREE = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def _letters() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane; 0 where it is no letter."""
    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        x = chr(c)
        if unicodedata.category(x)[0] == "L":
            out[c] = ord(x.lower()[0])
    return out


_TABLE: list[np.ndarray] = []


def grams(text: str) -> np.ndarray:
    """The distinct n-gram slots of a text, sorted; empty if it has no letter."""
    if not _TABLE:
        _TABLE.append(_letters())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.zeros(len(points) + 2, np.uint32)
    _TABLE[0].take(points, mode="clip", out=s[1:-1])
    if len(points) and points.max() > 0xFFFF:
        high = np.flatnonzero(points > 0xFFFF)
        one, back = np.unique(points[high], return_inverse=True)
        s[1 + high] = np.array([ord(chr(c).lower()[0]) if unicodedata.category(chr(c))[0] == "L" else 0 for c in one.tolist()], np.uint32)[back]
    if not s.any():
        return np.zeros(0, np.int64)
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]  # one bound between runs
    one = s * _ONE
    two = (one[:-1] + s[1:]) * _TWO
    three = ((two[:-1] ^ (two[:-1] >> _HALF)) + s[2:]) * _THREE
    h = np.concatenate([one[s > 0], two, three])
    h = (h ^ (h >> _HALF)) * _ONE >> _SHIFT
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])].astype(np.int64)


class Model:
    """Languages, the n-grams of the landmarks, and a weight for each n-gram and language."""

    def __init__(self, languages: list[str], codes: np.ndarray, weights: np.ndarray):
        self.languages, self.codes, self.weights = languages, codes, weights

    @classmethod
    def fit(cls, sets: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
        languages = sorted(set(labels))
        if not languages:
            return cls([], np.zeros(0, np.int64), np.zeros((0, 0)))
        of: dict[str, list[int]] = {}
        for i, x in enumerate(labels):
            of.setdefault(x, []).append(i)
        marks = [i for lang in languages for i in of[lang][: max(1, landmarks // len(languages))]]  # the first rows of each language
        codes = np.unique(np.concatenate([sets[i] for i in marks]))
        at = np.full(SPACE, -1)
        at[codes] = np.arange(len(codes))
        base = np.zeros((len(marks), len(codes)))
        for row, i in enumerate(marks):
            base[row, at[sets[i]]] = len(sets[i]) ** -0.5
        kernel = np.zeros((len(sets), len(marks)))
        for row, s in enumerate(sets):
            k = at[s]
            kernel[row] = base[:, k[k >= 0]].sum(axis=1) * len(s) ** -0.5
        own = kernel[marks]
        targets = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
        weight = np.array([1 / len(of[x]) for x in labels])[:, None] * len(labels) / len(languages)
        # Nystroem ridge: min |K a - y|^2 + ridge * n * a' own a
        alpha = np.linalg.solve(kernel.T @ (kernel * weight) + ridge * len(sets) * own + 1e-8 * np.eye(len(marks)), kernel.T @ (targets * weight))
        return cls(languages, codes, base.T @ alpha)

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text. The score is the softmax share of the best margin, 0 to 1."""
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        lang, score = [], []
        width = max(1, min(len(texts), 8_000_000 // max(1, len(self.codes))))
        for i in range(0, len(texts), width):
            some = [grams(t) if t else np.zeros(0, np.int64) for t in texts[i : i + width]]
            x = np.zeros((len(some), len(self.codes)), np.float32)
            norm = np.array([max(1, len(s)) for s in some]) ** -0.5
            for row, s in zip(x, some, strict=True):
                k = np.searchsorted(self.codes, s)
                k[k == len(self.codes)] = 0
                row[k[self.codes[k] == s]] = 1
            f = (x @ self.weights.astype(np.float32)).astype(np.float64) * norm[:, None]
            e = np.exp(4 * (f - f.max(axis=1, keepdims=True)))
            best = f.argmax(axis=1)
            share = 1 / e.sum(axis=1)
            for s, b, p in zip(some, best.tolist(), share.tolist(), strict=True):
                lang.append(self.languages[b] if len(s) else "und")
                score.append(float(p) if len(s) else 0.0)
        return lang, score


def sample(labelled: DataFrame, text_col: str, label_col: str, per_language: int = PER_LANGUAGE) -> list[tuple[str, np.ndarray]]:
    """Different labelled texts of each language as n-gram sets, chosen by a hash of the text, in its order."""
    mixed = F.xxhash64(F.col(f"`{text_col}`"), F.lit(5))
    narrow = labelled.select(mixed.alias("h"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{text_col}`").alias("text")).where("label is not null and text is not null")
    counts = {r[0]: r[1] for r in narrow.groupBy("label").agg(F.approx_count_distinct("h")).orderBy("label").limit(SAMPLE + 1).collect()}
    if len(counts) > SAMPLE:
        raise ValueError(f"{label_col} has more than {SAMPLE} different values")
    if not counts:
        return []
    most = max(1, min(per_language, SAMPLE // len(counts)))
    # twice the bound is drawn by hash, so that the bound is met; what is over it goes below
    shares = F.map_from_arrays(F.array(*[F.lit(x) for x in counts]), F.array(*[F.lit(int(min(1.0, 2.0 * most / n) * (1 << 30))) for n in counts.values()]))
    drawn = narrow.where(F.pmod("h", F.lit(1 << 30)) < F.element_at(shares, F.col("label")))
    schema = "label string, h long, codes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [grams(t).astype("<i4").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(codes, pa.binary())], names=["label", "h", "codes"])

    rows = sorted((r[0], r[1], bytes(r[2])) for r in drawn.mapInArrow(lean(run), schema).where("length(codes) > 0").distinct().collect())
    out, taken = [], {}
    for label, _, codes in rows:
        if taken.get(label, 0) < most:
            taken[label] = taken.get(label, 0) + 1
            out.append((label, np.frombuffer(codes, "<i4").astype(np.int64)))
    return out


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    prepare(labelled.sparkSession)
    rows = sample(labelled, text_col, label_col, per_language)
    return Model.fit([s for _, s in rows], [x for x, _ in rows])


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Append ``lang_pred`` and ``score`` (with a leading underscore where a column clashes). Only the text is read for them."""
    prepare(df.sparkSession)
    names = fresh(df, "lang_pred", "score")
    schema = StructType([*df.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    where = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = model.score(b.column(where).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return df.mapInArrow(lean(run), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
