"""Personal data: four base patterns, and a skip-chain conditional random field that adds spans.

Base spans (email, ip, card, phone) are exact regular-expression matches over the whole text, found
by scans that are linear in its length. The field's nodes are a document's tokens that hold a
digit or ``@`` (all others are outside by definition). Node potentials come from the token's own form
and from the words before it, chain edges link neighbours, and skip edges link the tokens with the
same letters or digits, however far apart: to one with a base label where there is one, else through
a hub that all share.

Nodes, chain and skip are fitted together, by pseudo-likelihood, on a bounded sample of documents
whose base spans serve as labels, with part of the evidence hidden: each node counts once as it is,
once without its form and once without its context. A hidden form leaves the label to context and
edges, so the edges learn to carry what a pattern sees here to where none sees it. Tokens that share
letters or digits with a base span without being in one are unknown, not outside. A fifth label,
``secret``, learns from long tokens assigned to a name such as ``token`` or ``password``. No base
pattern finds it, but the pattern that labels it would find most of what the field adds.

Decoding is damped loopy sum-product with base labels clamped, until messages settle. Base spans
always stay; added spans (of any kind) never overlap one of their kind.

Defined results: a null or empty text has no spans. Equal texts get equal spans. Ids are not read, so
null and repeated ones change nothing; repeated texts count once in the sample. Added columns take a
leading underscore where they clash. An empty table gives no rows, and a field that adds nothing but
recurrences of base spans.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .runtime import fresh, lean, prepare

#: Kinds of the base patterns, and all kinds of spans in their order.
KINDS = ("email", "ip", "card", "phone")
SPAN_KINDS = (*KINDS, "secret")
#: Documents with nodes that the field is fitted on at most (the bound of the sample), hashed features, the move under which messages have settled, rounds after which damping is stronger (a field that still swings stops after four times as many), and the probability that adds a span.
SAMPLE, FEATURES, SETTLED, ROUNDS, LEAST = 3000, 4096, 1e-3, 100, 0.6
#: Features of a node: the first is always there, then those of its form, then those of its context.
FORM, CONTEXT = 9, 3
#: What a skip edge costs at first whose ends differ, and how much this counts against the sample.
DISAGREE, PRIOR = 3.0, 4.0
SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("base", BooleanType())]))
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_MARKED = re.compile(r"[0-9@]")
_WHITE = re.compile(r"\s")
_WORD = re.compile(r"[^\W\d_]+|[=:|]")
_SHAPES = [(re.compile("[A-Z]+"), "A"), (re.compile("[a-z]+"), "a"), (re.compile("[^\x00-\x7f]+"), "u")]
#: Assignments of a long value to a name that says it is secret; labels for fitting only.
_ASSIGNED = re.compile(r"(?i)(?:token|secret|password|passwd|credential|api[_-]?key|access[_-]?key)s?[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_.=-]{16,})")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, each kind leftmost without overlaps, in the order of kinds and starts."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not any(map(text.__contains__, "0123456789")):
        return out
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, begin = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):  # four runs make a match, the next begins after them
                size = sum(map(len, parts[i : i + 4])) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts[i : i + 4]):
                    out.append((1, begin, begin + size))
                begin += size + 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _nodes(text: str) -> list[tuple[int, int]]:
    """Tokens between white space that hold a digit or ``@``, without their outer punctuation."""
    out, end = [], 0
    m = _MARKED.search(text)
    while m:
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        stop = _WHITE.search(text, m.end())
        end = stop.start() if stop else len(text)
        i, j = start, end
        while i < j and text[i] in "\"'([{<,;:":
            i += 1
        while j > i and text[j - 1] in "\"')]}>,;:.!?":
            j -= 1
        if i < j:
            out.append((i, j))
        m = _MARKED.search(text, end)
    return out


def shape(token: str) -> str:
    """Runs of capitals, small letters and others collapsed to one sign; digits as their number up to 20."""
    for pattern, sign in _SHAPES:
        token = pattern.sub(sign, token)
    return re.sub("[0-9]+", lambda m: f"<{min(20, len(m[0]))}>", token)


def _mixture(token: str) -> str:
    """Which sorts of characters a token has, and whether it reads as hexadecimal."""
    sorts = "".join(sign for sign, p in (("A", "[A-Z]"), ("a", "[a-z]"), ("0", "[0-9]"), ("u", "[^\x00-\x7f]"), (".", "[^A-Za-z0-9\x80-\U0010ffff]")) if re.search(p, token))
    return sorts + ("x" if re.fullmatch("[0-9a-fA-F]{16,}", token) else "")


def _validity(digits: str, token: str) -> str:
    """Whether a number that looks like a card or an address holds up as one."""
    if 13 <= len(digits) <= 19:
        return "luhn" if luhn(digits) else "no luhn"
    parts = token.split(".")
    if len(parts) == 4 and all(p.isdecimal() for p in parts):
        return "octets" if all(int(p[-4:]) <= 255 for p in parts) else "no octets"
    return "none"


def _keys(token: str) -> set[str]:
    """What tokens share that skip edges link."""
    digits = "".join(c for c in token if "0" <= c <= "9")
    return {token.lower(), digits if len(digits) >= 5 else token.lower()}


def recurrences(text: str, nodes: list[tuple[int, int]], label: np.ndarray) -> tuple[np.ndarray, int]:
    """Skip edges that decoding uses, and the number of hubs; hubs are numbered after the nodes."""
    groups: dict[str, list[int]] = {}
    for i, (s, e) in enumerate(nodes):
        for key in _keys(text[s:e]):
            groups.setdefault(key, []).append(i)
    edges, hubs = [], 0
    for _, group in sorted(groups.items()):
        known = [i for i in group if label[i]]
        if known:  # it is certain, so the others need no edges between them
            last = known[0]
            for i in group:
                last = i if label[i] else last
                if not label[i]:
                    edges.append((last, i))
        elif len(group) == 2:
            edges.append(tuple(group))
        elif len(group) > 2:
            edges += [(len(nodes) + hubs, i) for i in group]
            hubs += 1
    return np.array(edges, np.int64).reshape(-1, 2), hubs


def document_graph(text: str, base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], np.ndarray, list[list[int]], np.ndarray, np.ndarray]:
    """Nodes, labels from base spans (0: outside), features of each, chain edges and skip edges."""
    nodes = _nodes(text)
    label = _labels(nodes, base)
    features, chain, skip, last = [], [], [], {}
    for i, (s, e) in enumerate(nodes):
        token = text[s:e]
        words = ["^", "^", *_WORD.findall(text[max(0, s - 40) : s].lower())][-2:]
        sh = shape(token)
        digits = "".join(c for c in token if "0" <= c <= "9")
        form = ["s=" + sh, f"d={min(20, len(digits))}", f"l={min(30, e - s)}", "p=" + sh[:4], "q=" + sh[-4:], "v=" + _validity(digits, token), "m=" + _mixture(token), f"c={min(16, len(set(token)))}", f"b={(e - s).bit_length()}{'@' in token}"]
        context = ["w=" + words[-1], "ww=" + " ".join(words), "x=" + ("" if e >= len(text) else shape(text[e]))]
        features.append([crc32(n.encode()) % (FEATURES - 1) + 1 for n in (*form, *context)])
        if i and s - nodes[i - 1][1] <= 3:
            chain.append((i - 1, i))
        for key in _keys(token):
            if key in last:
                skip.append((last[key], i))
            last[key] = i
    return nodes, label, features, np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)


def _labels(nodes: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> np.ndarray:
    label = np.zeros(len(nodes), np.int64)
    starts = np.array([s for s, _ in nodes] or [0])
    for kind, s, e in spans:
        i = max(0, int(np.searchsorted(starts, s, side="right")) - 1)
        while i < len(nodes) and nodes[i][0] < e:
            if nodes[i][1] > s:
                label[i] = kind + 1
            i += 1
    return label


def labelled_graph(text: str) -> tuple:
    """Labels to fit on (-1: unknown), features, chain and skip edges of a text."""
    nodes, label, features, chain, skip = document_graph(text, base_spans(text))
    secret = _labels(nodes, [(len(KINDS), *m.span(1)) for m in _ASSIGNED.finditer(text) if _DIGIT.search(m[1])])
    label = np.where(label > 0, label, secret)
    known = {key for (s, e), y in zip(nodes, label, strict=True) if y for key in _keys(text[s:e])}
    unknown = [not y and bool(_keys(text[s:e]) & known) for (s, e), y in zip(nodes, label, strict=True)]
    return np.where(unknown, -1, label), features, chain, skip


class Field:
    """Weights of the field: nodes (feature x label; row 0 is the bias), chain and skip (label x label)."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.node, self.chain, self.skip = node, chain, skip

    @classmethod
    def fit(cls, graphs: list[tuple], rounds: int = 150) -> Field:
        """Nodes, chain and skip together, by the likelihood of each label given its neighbours' (adaptive gradient steps)."""
        labels = len(SPAN_KINDS) + 1
        node, chain = np.zeros((FEATURES, labels)), np.zeros((labels, labels))
        prior = -DISAGREE * (1 - np.eye(labels))
        if not graphs:
            return cls(node, chain, prior)
        first = np.cumsum([0] + [len(g[0]) for g in graphs])
        y = np.concatenate([g[0] for g in graphs])
        x = np.array([f for g in graphs for f in g[1]], np.int64).reshape(-1, FORM + CONTEXT)
        ends = [np.concatenate([g[k] + n for g, n in zip(graphs, first[:-1], strict=True)]) for k in (2, 3)]
        ends = [e[(y[e] >= 0).any(axis=1)] for e in ends]
        # the neighbours that a node's label is judged by: before and after it in the chain, and along skip edges
        sides = [(0, ends[0][:, 0], ends[0][:, 1], False), (0, ends[0][:, 1], ends[0][:, 0], True), (1, ends[1][:, 0], ends[1][:, 1], False), (1, ends[1][:, 1], ends[1][:, 0], True)]
        sides = [(t, a[(y[a] >= 0) & (y[b] >= 0)], b[(y[a] >= 0) & (y[b] >= 0)], turned) for t, a, b, turned in sides]
        known = np.flatnonzero(y >= 0)
        target = np.eye(labels)[np.maximum(y, 0)]
        views = [(np.arange(FORM + CONTEXT), 1.0), (np.arange(FORM, FORM + CONTEXT), 0.5), (np.arange(FORM), 0.5)]
        orders = [np.argsort(c, kind="stable") for c in x.T]
        heads = [np.flatnonzero(np.concatenate([[True], np.diff(c[o]) > 0])) for c, o in zip(x.T, orders, strict=True)]
        tables, start = [node, chain, prior.copy()], [0.0, 0.0, prior]
        speed = [np.zeros_like(t) for t in tables]
        for _ in range(rounds):
            grads = [np.zeros_like(t) for t in tables]
            near = np.zeros((len(y), labels))
            for t, a, b, turned in sides:
                np.add.at(near, b, (tables[1 + t].T if turned else tables[1 + t])[y[a]])
            for columns, weight in views:
                z = node[0] + node[x[:, columns]].sum(axis=1) + near
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p = (p / p.sum(axis=1, keepdims=True) - target) * weight
                p[y < 0] = 0
                grads[0][0] += p.sum(axis=0)
                for k in columns.tolist():  # rows of equal features add up
                    grads[0][x[orders[k][heads[k]], k]] += np.add.reduceat(p[orders[k]], heads[k], axis=0)
                for t, a, b, turned in sides:
                    own = np.zeros((labels, labels))
                    np.add.at(own, y[a], p[b])
                    grads[1 + t] += own.T if turned else own
            grads[2] = (grads[2] + grads[2].T) / 2  # a skip edge has no direction
            for t, g, s, fixed, pull in zip(tables, grads, speed, start, (0.05, 0.5, PRIOR), strict=True):
                g += pull * (t - fixed)
                g /= max(1, len(known))
                s += g**2
                t -= 0.3 * g / (np.sqrt(s) + 1e-8)
        return cls(node, np.clip(tables[1], -4, 4), np.clip(tables[2], -6, 6))

    def marginals(self, label: np.ndarray, features: list[list[int]], chain: np.ndarray, skip: np.ndarray, hubs: int = 0) -> np.ndarray:
        """Label probabilities by damped loopy sum-product until it settles; nodes with a base label are clamped to it, hubs come after the nodes."""
        unary = self.node[0] + self.node[np.array(features)].sum(axis=1)
        unary[label > 0] = -30
        unary[np.arange(len(label)), label] = np.where(label > 0, 0, unary[np.arange(len(label)), label])
        unary = np.vstack([unary, np.zeros((hubs, unary.shape[1]))])
        src = np.concatenate([chain[:, 0], skip[:, 0], chain[:, 1], skip[:, 1]])
        dst = np.concatenate([chain[:, 1], skip[:, 1], chain[:, 0], skip[:, 0]])
        half = len(src) // 2
        if half:
            weight = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0), np.repeat(self.chain.T[None], len(chain), 0), np.repeat(self.skip.T[None], len(skip), 0)])
            back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
            message = np.zeros((2 * half, unary.shape[1]))
            for turn in range(4 * ROUNDS):
                belief = unary.copy()
                np.add.at(belief, dst, message)
                out = belief[src] - message[back]
                new = np.logaddexp.reduce(out[:, :, None] + weight, axis=1)
                new -= new.max(axis=1, keepdims=True)
                moved, step = np.abs(new - message).max(), 0.5 if turn < ROUNDS else 0.1
                message = (1 - step) * message + step * new
                if moved < SETTLED:
                    break
            np.add.at(unary, dst, message)
        unary = unary[: len(label)]
        p = np.exp(unary - unary.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def spans(self, text: str) -> list[tuple[int, int, int, bool]]:
        """(kind, start, end, base) of a text, by kind and start."""
        base = base_spans(text)
        out = [(*x, True) for x in base]
        nodes, label, features, chain, _ = document_graph(text, base)
        if nodes:
            p = self.marginals(label, features, chain, *recurrences(text, nodes, label))
            best = p.argmax(axis=1)
            for i in np.flatnonzero((label == 0) & (best > 0) & (p.max(axis=1) >= LEAST)).tolist():
                out.append((int(best[i]) - 1, *nodes[i], False))
        return sorted(out)


def train(df: DataFrame, text_col: str = "text", most: int = SAMPLE) -> Field:
    """Fit the field on ``most`` different texts with nodes at most, chosen by a hash of the text."""
    prepare(df.sparkSession)
    text = F.col(f"`{text_col}`")
    mixed = F.xxhash64(text, F.lit(2))
    marked = df.where(text.rlike("[0-9@]"))
    share = min(1.0, 1.2 * most / max(1, marked.select(F.approx_count_distinct(mixed)).first()[0]))
    some = marked.where(F.pmod(mixed, F.lit(1 << 30)) < int(share * (1 << 30))).select(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            graphs = [labelled_graph(t) for t in b.column(0).to_pylist() if t]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(g) for g in graphs if len(g[0])], pa.binary())], names=["graph"])

    graphs = some.mapInArrow(lean(run), "graph binary").distinct().orderBy(F.xxhash64("graph"), "graph").limit(most).collect()
    return Field.fit([pickle.loads(bytes(r[0])) for r in graphs])


def find(df: DataFrame, field: Field, text_col: str = "text", out_col: str = "pii", keep: list[str] | None = None) -> DataFrame:
    """Append an array of spans (kind, start, end in code points, base), by kind as in SPAN_KINDS and start."""
    prepare(df.sparkSession)
    keep = list(df.columns) if keep is None else keep
    part = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])])
    (name,) = fresh(part.select(*[F.col(f"`{c}`") for c in keep]), out_col)
    schema = StructType([f for f in part.schema.fields if f.name in keep] + [StructField(name, SPANS)])
    where, kept = part.columns.index(text_col), [i for i, c in enumerate(part.columns) if c in keep]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [[{"kind": SPAN_KINDS[k], "start": s, "end": e, "base": x} for k, s, e, x in field.spans(t)] if t else [] for t in b.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], pa.array(made, kind)], names=schema.names)

    return part.mapInArrow(lean(run), schema)


def redacted(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, end = [], 0
    for kind, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[end:s], f"[{SPAN_KINDS[kind].upper()}]"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def redact(df: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """Replace the spans in ``text_col``; every row and column stays."""
    prepare(df.sparkSession)
    where, schema = df.columns.index(text_col), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [redacted(t, field.spans(t)) if t else t for t in b.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:where], pa.array(texts, pa.string()), *b.columns[where + 1 :]], names=schema.names)

    return df.mapInArrow(lean(run), schema)
