"""Chat formatting, whitening and fill-in-the-middle against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import chat, fim, queries, sharding, vecdedup, whitening

R = random.Random(3)
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
CONTROL = re.compile(r"\\|<turn>|<says>|</turn>|<\|endoftext\|>")


def texts():
    bits = ["a", " ", "é", "日", "\\", "<turn>", "</turn>", "<says>", "\n", "🙂", "<|endoftext|>", "</", "turn>", "x" * 40]
    return ["", "\\", "\\\\", "ends with \\", *["".join(R.choices(bits, k=R.randint(1, 12))) for _ in range(40)]]


@pytest.fixture(scope="module")
def turns(spark):
    made = [(c, k, R.choice(["user", "assistant", "system", "<turn>", None]), R.choice([*texts(), None])) for c in range(20) for k in range(R.randint(1, 9))]
    made += [(50, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(300)]  # more than one partition's share
    made += [(51, 0, "user", "again")] * 3 + [(52, 5, "user", "b"), (52, 5, "assistant", "a"), (52, None, "user", "first")]
    made += [(None, k, "assistant", "of no one") for k in range(4)] + [(53, 0, "assistant", "long \\ </turn> é" * 20_000)]
    R.shuffle(made)
    return made


SCHEMA = "conv_id long, turn long, role string, text string"


def brute_talks(turns):
    by = defaultdict(list)
    for c, k, r, t in turns:
        by[c].append(((k is not None, k or 0), r or "", t or ""))
    out = {}
    for c, own in by.items():
        own.sort(key=lambda x: x[:2])
        loss = "".join(t for _, r, t in own if r == "assistant")
        n = sum(len("<turn><says></turn>") + sum(len(x) + len(CONTROL.findall(x)) for x in (r, t)) for _, r, t in own)
        out[c] = (len(own), sha("".join(f"{r}\n{t}\n" for _, r, t in own)), len(loss), sha(loss), n)
    return out


@pytest.mark.parametrize("parts", [4, 40])
def test_chat_reads_back_what_was_said(spark, turns, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(turns, SCHEMA).withColumn("Place", F.lit(1)).repartition(5)
        made = chat.format_turns(df, queries.BYTE_BPE)
        assert made.columns[:5] == [*df.columns] and made.columns[5:7] == ["_place", "ids"]
        got = {r.conv: tuple(r)[1:] for r in chat.digest_turns(chat.read_turns(made, queries.BYTE_BPE)).collect()}
        assert got == brute_talks(turns)
        by = defaultdict(list)
        for r in made.collect():
            by[r.conv_id].append((r._place, r))
        t = chat.template(queries.BYTE_BPE)
        for own in by.values():
            own.sort(key=lambda x: x[0])
            assert [k for k, _ in own] == list(range(len(own)))
            tokens = chars = 0
            for _, r in own:
                ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
                assert (r.token_start, r.n_tokens, r.char_start) == (tokens, len(ids), chars)
                assert [x for x in ids if x >= t.open] == [*t.reserved]
                masked = t.unescape(t.decode(ids[r.loss_start - tokens : r.loss_end - tokens]))
                assert masked == ((r.text or "") if r.role == "assistant" else "")
                tokens, chars = tokens + len(ids), chars + r.n_chars
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_chat_of_nothing(spark):
    made = chat.format_turns(spark.createDataFrame([], SCHEMA), queries.BYTE_BPE)
    assert made.count() == 0 and chat.digest_turns(chat.read_turns(made, queries.BYTE_BPE)).count() == 0


def test_ranks_give_the_ids_of_the_vocabulary():
    import public_tokenizers

    t, u = chat.template(queries.BYTE_BPE), chat.template(queries.BYTE_BPE, queries.BYTE_RANKS, public_tokenizers.PATTERN)
    odd = [*texts(), " " * 300_000 + "x", "a" * 50_000, "don't  stop\r\n\t日本 1234567 <|endoftext|>", "\x00é" * 99]
    assert t.encode(odd) == u.encode(odd) and u.by_ranks is not None


def test_escaping_is_reversible():
    t = chat.template(queries.BYTE_BPE)
    for x in texts():
        e = t.escape(x)
        assert t.unescape(e) == x and not re.search(r"(?<!\\)(\\\\)*</turn>", e)


def test_op11_query(spark, tmp_path, turns):
    spark.createDataFrame(turns, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    odd = r"\### Assistant: </turn> ok"
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_chat(spark, str(tmp_path)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()}
    assert got == brute_talks([*turns, (-7, 0, "user", odd), (-7, 1, "assistant", odd)])


def whitened(rows):
    by = defaultdict(dict)
    for r in rows:
        by[r.vec_id][r.component] = r
    return by


def held_against_numpy(got, vectors, wanted):
    """Values, shares and whitened rows of ``got`` are those of the dense covariance, up to sign; returns the identity error."""
    x = np.floor(64 * np.array([v for _, v in vectors])).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (x - s // n) - (s % n) / n
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = int((e[:wanted] > 1e-10 * e[0]).sum())
    for row, (i, _) in enumerate(vectors):
        own = got[i]
        assert sorted(own) == list(range(1, k + 1))
        assert {(r.n, int(r.deviation)) for r in own.values()} == {(n, sum((n * a - b) ** 2 for a, b in zip(x[row].tolist(), s.tolist(), strict=True)))}
    w = np.array([[got[i][j + 1].whitened for j in range(k)] for i, _ in vectors])
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9
    some = next(iter(got.values()))
    assert np.allclose([some[j + 1].explained for j in range(k)], e[:k] / np.trace(cov), rtol=1e-9)
    return w, c, e[:k], u[:, :k], some[1].identity_error


def test_whitening_equals_dense_eigenvectors(spark):
    r = np.random.default_rng(2)
    v = (r.standard_normal((400, 20)) @ np.diag(np.linspace(3, 0.5, 20))).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(500, None), (501, [float("nan")] * 20), (502, [float("inf")] + [0.0] * 19), (503, [None] + [0.0] * 19), (504, []), (505, [1.0, 2.0])]
    df = spark.createDataFrame([(*x, 1) for x in rows + odd], "vec_id long, embedding array<float>, label int").repartition(5)
    got = whitened(whitening.whiten(df, 8).collect())
    assert sorted(i for i in got if i >= 500) == [504, 505] and all([*got[i]] == [None] and got[i][None].n == 400 for i in (504, 505))
    w, c, e, u, error = held_against_numpy(got, rows, 8)
    y = c @ u / np.sqrt(e)
    assert np.abs(np.abs(w) - np.abs(y)).max() < 1e-8 and error < 1e-9


def test_whitening_of_dependent_and_equal_directions(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((300, 3))
    v = np.hstack([np.floor(base * 64) / 64, np.floor(base * 64) / 64, np.zeros((300, 4))])  # rank 3 of 10
    rows = [(i, x.tolist()) for i, x in enumerate(v)] * 1
    got = whitened(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 6).collect())
    assert len(got[0]) == 3
    assert held_against_numpy(got, rows, 6)[-1] < 1e-9
    cube = [(i, [float(b) for b in f"{i:05b}"]) for i in range(32)]  # every direction alike
    got = whitened(whitening.whiten(spark.createDataFrame(cube, "vec_id long, embedding array<double>"), 3).collect())
    assert held_against_numpy(got, cube, 3)[-1] < 1e-9
    still = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)] + [(None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(x.component, x.n, x.whitened) for x in whitening.whiten(still).collect()] == [(None, 6, None)] * 6
    assert whitening.whiten(still.limit(0)).count() == 0
    clash = whitening.whiten(spark.createDataFrame([(i, [1.0 * i, 2.0]) for i in range(5)], "N long, v array<double>"), 2, "N", "v")
    assert clash.columns == ["N", "component", "_n", "deviation", "whitened", "explained", "identity_error"] and clash.count() == 5


def test_large_entries_and_exact_deviations(spark):
    rows = [(i, [1e9 * (i % 3), 1e30 if i == 1 else -0.01 * i]) for i in range(7)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2).collect()
    x = [[int(np.floor(np.clip(64 * c, -(2.0**52), 2.0**52))) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(a) for a in zip(*x, strict=True)]
    want = {i: sum((7 * a - b) ** 2 for a, b in zip(x[i], s, strict=True)) for i, _ in rows}
    assert all(int(r.deviation) == want[r.vec_id] for r in got)


@pytest.mark.parametrize("repeats", [1, 7])
def test_lanczos_iterates_restarts_and_finds_repeated_values(repeats):
    r = np.random.default_rng(repeats)
    d, k = 300, 10
    values = np.sort(np.concatenate([np.repeat(r.uniform(5, 9, 12), repeats)[:80], r.uniform(0, 4, 220 if repeats == 7 else 288)]))[::-1][:d]
    q = np.linalg.qr(r.standard_normal((d, d)))[0]
    v = (q * values) @ q.T
    e, u, trace, passes = whitening.lanczos(lambda b: (v @ b, float(np.trace(v))), d, k, most=40)
    assert np.allclose(e, values[:k], rtol=1e-11) and passes > 4
    assert np.abs(v @ u - u * e).max() < 1e-10 and np.abs(u.T @ u - np.eye(k)).max() < 1e-12


DOCS = [(1, None), (2, ""), (3, "a"), (4, "é日🙂"), (5, "has <P> in it"), (6, "has <M>"), (7, "<S"), (8, "P>"), (9, "日本語 text 🙂 " * 9000), (9, "one id, two texts"), (9, "one id, two texts"), (None, "no id"), *[(i, "".join(R.choices("ab é<SMP>日\n🙂", k=R.randint(0, 60)))) for i in range(10, 400)]]


def brute_fim(i, t, rate=90, spm=20):
    t = t or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[j : j + 8], 16) for j in range(0, 32, 8)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or h[2] % 100 >= rate or any(m in t for m in ("<P>", "<S>", "<M>")):
        return i, n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return (i, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (i, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fim_equals_brute_force(spark, tmp_path):
    key = lambda x: (x[0] is None, x[0] or 0, x[-1])
    df = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, Form string").repartition(3)
    made = fim.transform(df)
    assert made.columns == ["doc_id", "text", "Form", "n_units", "_form", "prefix_units", "middle_units", "output"]
    rows = made.select("doc_id", "n_units", "_form", "prefix_units", "middle_units", "output", "text", fim.restore(F.col("output"), F.col("_form")).alias("back")).collect()
    assert sorted((tuple(r)[:6] for r in rows), key=key) == sorted((brute_fim(*x) for x in DOCS), key=key)
    assert all(r.back == (r.text or "") for r in rows) and {r._form for r in rows} == {"plain", "psm", "spm"}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_fim(spark, str(tmp_path)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()
    want = [(*x[:5], sha(x[5]), sha(t or "")) for x, (_, t) in ((brute_fim(*d), d) for d in DOCS)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert fim.transform(df.limit(0)).count() == 0


def test_units_and_selection():
    assert bin(fim.unit_starts(" one  two\té ".encode(), "words")).count("1") == 3
    assert fim.unit_starts(b"", "words") == 0 and fim.unit_starts(b"  ", "words") == 1 and fim.unit_starts("é日a".encode()) == 0b100101
    for _ in range(200):
        n = R.randint(1, 400)
        bits = R.getrandbits(n) | 1
        at = [i for i in range(n) if bits >> i & 1]
        k = R.randrange(len(at))
        assert fim.select(bits, k, n) == at[k]
    for _ in range(200):
        x = "".join(R.choices(" ab\n", k=R.randint(0, 30))).encode()
        heads = [m.start() for m in re.finditer(rb"\S+", x)]
        want = [0, *heads[1:]] if heads else [0] if x else []
        assert [i for i in range(len(x)) if fim.unit_starts(x, "words") >> i & 1] == want
    with pytest.raises(ValueError):
        fim.transform(None, units="lines")


def test_rows_with_one_key_lie_in_many_ranges(spark, monkeypatch):
    widest = []
    ranked = sharding.global_rank

    def watched(scratch, df, order, rank, parts=None):
        out, kept = ranked(scratch, df, order, rank, 8)
        spread = df.repartitionByRange(8, *order).groupBy(F.spark_partition_id()).count().collect()
        widest.append(max(r["count"] for r in spread))
        return out, kept

    monkeypatch.setattr(sharding, "global_rank", watched)
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.lit("one").alias("source"), F.lit(1).alias("Salt")).repartition(4)
    got = sharding.shard_rows(df, 16).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 4000 and all(sorted(x) == list(range(250)) for x in slots.values()) and len(slots) == 16
    assert max(widest) < 1500 and set(got[0].asDict()) == {"doc_id", "source", "Salt", "shard", "slot"}


@pytest.mark.parametrize("sample, rounds", [(4096, 1), (1, 2)])
def test_a_sample_without_links_measures_nothing(spark, monkeypatch, sample, rounds):
    """Of 300 vectors two are near; a sample of one of the others holds no link, so a wider round follows, once."""
    r = np.random.default_rng(8)
    v = r.standard_normal((300, 24))
    v[299] = v[298] + 0.01
    made, links = [], vecdedup._pass_links
    monkeypatch.setattr(vecdedup, "_pass_links", lambda *a: made.append(a) or links(*a))
    monkeypatch.setattr(vecdedup, "SAMPLE", sample)
    if sample == 1:
        monkeypatch.setattr(vecdedup, "_sampled_links", lambda classes, *_: classes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
    got = {x.vec_id: x for x in vecdedup.near_duplicates(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()}
    assert len(made) == rounds and (got[299].component_id, got[299].n_links, got[5].n_links) == (298, 1, 0)
