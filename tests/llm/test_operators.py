"""Operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import io
import random
import re
import wave
from collections import defaultdict
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import bpe, components, langid, lmscore, media, minhash, packing, pii, repeats, sharding, vecdedup
from keyloom.llm.queries import WORD_BPE
from keyloom.llm.runtime import Scratch
from keyloom.llm.textkeys import shingles, word_hashes

random.seed(1)
VOCABULARY = ["".join(random.choices("abcdefghé", k=random.randint(1, 8))) for _ in range(60)]


def prose(n):
    return " ".join(random.choices(VOCABULARY, k=n))


LONG = prose(3000)
DOCS = [(0, None), (1, ""), (2, "  \n "), (3, "One."), (4, LONG), (5, LONG), (6, LONG.replace(VOCABULARY[0], "zz", 3)), (7, prose(80)), (8, "Don't <|endoftext|> ... É\x1cx ß 12 日本 &"), (8, "Don't <|endoftext|> ... É\x1cx ß 12 日本 &"), (9, prose(40) + " " + LONG[:900]), (10, "x" * 4000), (11, LONG[300:1500])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_bpe_equals_the_library_and_reuses_chunks(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    got = bpe.encode_and_decode(docs, WORD_BPE).collect()
    assert len(got) == len(DOCS)
    for r in got:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode_and_decode(empty, WORD_BPE).count() == 0
    clash = docs.withColumn("ids", F.lit(1)).withColumn("N_TOKENS", F.lit(2))
    assert bpe.encode_and_decode(clash, WORD_BPE).columns == ["doc_id", "text", "ids", "N_TOKENS", "_n_tokens", "_ids", "decoded"]
    with pytest.raises(ValueError):
        bpe.encode_documents(clash, WORD_BPE)
    again = bpe.decode_documents(bpe.encode_documents(docs, WORD_BPE), WORD_BPE)
    assert again.where(F.col("text").rlike(r"\S") & (F.col("decoded") == "")).count() == 0


def test_chunks_join_to_the_text_and_are_cut_alike():
    raw = LONG.encode()
    cut = bpe.content_chunks(raw)
    assert b"".join(cut) == raw and len(cut) > 5
    assert len(set(bpe.content_chunks(b"another head " + raw)) & set(cut)) > len(cut) / 2


def test_packing_places_every_id_once(docs, empty):
    n = 256
    pieces = packing.token_pieces(docs, WORD_BPE, 2, n)
    rows = packing.pack(pieces, n, ["doc_id", "start", "ids"]).collect()
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for spots in by_seq.values():
        end = 0
        for o, k in sorted(spots):
            assert o == end
            end += k
        assert end <= n
    assert sorted(by_seq) == list(range(len(by_seq)))
    covered = defaultdict(int)
    for r in rows:
        covered[r.doc_id, r.doc_tokens] += r.length
    assert all(v % k[1] == 0 for k, v in covered.items())
    assert packing.pack(packing.token_pieces(empty, WORD_BPE, 2, n), n, ["doc_id", "start"]).count() == 0


def test_plan_is_shortest_pack_first():
    assert packing.plan({3: 2, 2: 1}, 5) == [(1, ((3, 1), (2, 1))), (1, ((3, 1),))]
    h = {random.randint(1, 100): random.randint(1, 50) for _ in range(40)}
    got = defaultdict(int)
    for k, pattern in packing.plan(h, 100):
        assert sum(x * m for x, m in pattern) <= 100
        for x, m in pattern:
            got[x] += k * m
    assert got == h
    with pytest.raises(ValueError):
        packing.plan({101: 1}, 100)


def plain_spans(t):
    pats = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for kind, p in enumerate(pats):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == 0 or kind == 1 and all(int(x) <= 255 for x in m[0].split(".")) or kind == 2 and 13 <= len(d) <= 19 and pii.luhn(d) or kind == 3 and 9 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    for _ in range(20000):
        t = "".join(random.choices("a1@. -+()23450é@.@", k=random.randint(0, 30)))
        assert pii.base_spans(t) == plain_spans(t)
    for t in ("1" * 200000, "a" * 200000 + "@", "+1" + "(" * 200000, "1.2.3.4.5.6.7.8", "000000255.1.1.1", "256.1.1.1"):
        if len(t) < 100:
            assert pii.base_spans(t) == plain_spans(t)
        else:
            pii.base_spans(t)  # linear


def test_pii_keeps_base_spans_adds_recurrences_and_masks(spark, empty):
    phone = "+1 (276) 555-5999"
    data = [(i, f"{prose(5)} call {phone} {prose(3)} mail a{i}@b.example.com {prose(4)}") for i in range(60)] + [(60, f"call {phone} later 555-5999 end"), (61, None), (62, ""), (63, prose(30))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    field = pii.train(df)
    got = {r.doc_id: r for r in pii.find(df, field).collect()}
    for i, t in data:
        base = [(pii.KINDS.index(s.kind), s.start, s.end) for s in got[i].pii if s.base]
        assert base == plain_spans(t or "")
    assert [s.kind for s in got[60].pii] == ["phone", "phone"] and not got[60].pii[1].base
    assert got[63].pii == [] and got[61].pii == []
    masked = {r.doc_id: r.text for r in pii.redact(df, field).collect()}
    assert "555" not in masked[60] and masked[61] is None and masked[63] == data[63][1]
    blank = pii.train(empty)
    assert pii.find(empty, blank).count() == 0 and pii.find(df, blank).count() == len(data)


def test_pii_finds_all_of_many_recurrences(spark):
    text = "call +5551234567 " + " ".join(f"{prose(6)} 5551234567" for _ in range(50)) + " end"
    labels = len(pii.SPAN_KINDS) + 1
    neutral = pii.Field(np.zeros((pii.FEATURES, labels)), np.zeros((labels, labels)), -4 * (1 - np.eye(labels)))
    for field in (neutral, pii.train(spark.createDataFrame([(i, f"{prose(5)} call +555{1000000 + 7919 * i} {prose(3)}") for i in range(60)], "doc_id long, text string"))):
        assert len([x for x in field.spans(text) if x[0] == 3]) == 51
        assert "555" not in pii.redacted(text, field.spans(text))


def test_language_is_learned_from_text_alone(spark, empty):
    words = {"aa": ["bal", "dol", "kir"], "bb": ["ésu", "üto", "çap"], "cc": ["zyx", "wvu", "qqj"]}
    data = [(i, " ".join(random.choices(words[x], k=12)), x) for i, x in enumerate(random.choices(list(words), k=300))] + [(900, None, "aa"), (901, "12 !!", "bb"), (902, "", None), (903, "BAL DOL " * 9000, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.train(df.where(~langid.held_out()))
    got = {r.doc_id: r for r in langid.predict(df.withColumn("score", F.lit(0)), model).collect()}
    out = [i for i, _, _ in data[:300] if crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == data[i][2] for i in out) >= 0.98 * len(out)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r._score <= 1 for r in got.values())
    none = langid.train(empty.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}


def test_shards_match_the_mixture(spark):
    data = [(i, "hot" if i % 3 == 0 else f"s{i % 7}" if i % 5 else None, "t") for i in range(1000)] + [(5, "hot", "t")] * 3
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    rows = sharding.shard_rows(df, 16).collect()
    by = defaultdict(list)
    mix = defaultdict(lambda: [0] * 16)
    for r in rows:
        by[r.shard].append(r.slot)
        mix[r.source][r.shard] += 1
    assert len(rows) == len(data) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(max(v) - min(v) <= 2 for v in mix.values())
    assert sharding.shard_rows(df.limit(0), 16).count() == 0
    assert len({r.shard for r in sharding.shard_rows(df.limit(3), 16).collect()}) == 3


def brute_components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components_by_both_ways(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    links = [(random.randint(0, 200), random.randint(0, 200)) for _ in range(150)] + [(i, i + 1) for i in range(210, 260)] + [(3, 3)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = {r.node: r.component for r in components.components(Scratch(spark, "t"), df).collect()}
    want = brute_components(300, links)
    assert all(got.get(i, i) == want[i] for i in range(300))


def brute_groups(data, percent):
    sets = []
    for _, t in data:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(i, j) for i, j in combinations(range(len(data)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [len(s) for s in sets], brute_components(len(data), links)


@pytest.mark.parametrize("percent, rows_of_block", [(80, 256), (85, 4)])
def test_minhash_groups_equal_brute_force(spark, empty, monkeypatch, percent, rows_of_block):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", rows_of_block)
    base = [prose(120) for _ in range(6)]
    texts = [None, "", " ", "a b", "A  b", "a b c d e"]
    for b in base:
        for _ in range(12):
            w = b.split(" ")
            for _ in range(random.randint(0, 5)):
                w[random.randrange(len(w))] = random.choice(VOCABULARY) + "q"
            texts.append(" ".join(w))
    data = list(enumerate(texts))
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), percent).collect()}
    sizes, comp = brute_groups(data, percent)
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(data))] == [(n, c, c == i) for i, (n, c) in enumerate(zip(sizes, comp))]
    assert minhash.near_duplicates(empty).count() == 0


def test_keep_one_with_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, LONG, 1), (4, LONG, 2), (4, LONG, 2), (None, None, 3), (7, None, 4), (8, "x y", 5)], "doc_id long, text string, kept int")
    assert sorted((r.doc_id is None, r.doc_id or 0, r.kept) for r in minhash.keep_one(df).collect()) == [(False, 4, 2), (False, 7, 4), (False, 8, 5), (True, 0, 3)]


def test_signature_estimates_jaccard():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, 1000, dtype=np.uint64)
    y = np.concatenate([x[:800], r.integers(0, 2**63, 200, dtype=np.uint64)])
    est = np.mean([np.mean(minhash.signature(x + np.uint64(k)) == minhash.signature(y + np.uint64(k))) for k in range(20)])
    assert abs(est - 800 / 1200) < 0.03
    assert (minhash.signature(x[:1]) < minhash.SLOTS).all()


def brute_repeats(data, width):
    seen, out = {}, []
    for i, t in sorted(enumerate(data), key=lambda x: (x[1][0], x[0])):
        b, gone = (t[1] or "").encode(), set()
        for p in range(len(b) - width + 1):
            if b[p : p + width] in seen:
                gone |= set(range(p, p + width))
            else:
                seen[b[p : p + width]] = 1
        kept = bytes(c for p, c in enumerate(b) if p not in gone)
        out.append((t[0], len(b), len(gone), sum(p - 1 not in gone for p in gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [4000, 3])
def test_repeats_equal_brute_force(spark, empty, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "DEAL", 2)
    common = prose(60)
    data = [(0, None), (1, ""), (2, LONG), (3, LONG[200:2000] + "é" + LONG[2001:]), (4, prose(5)), (5, "ab" * 400), (6, "short")] + [(10 + i, prose(random.randint(1, 60)) + common + prose(30)) for i in range(12)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3).withColumn("kept", F.lit(0)).withColumn("cuts", F.lit(""))
    got = repeats.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", F.size("removed").alias("n"), F.sha2("_kept", 256).alias("h"))
    assert sorted(map(tuple, got.collect())) == brute_repeats(data, 100)
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_of_rows_with_one_id_and_of_null_ids(spark):
    df = spark.createDataFrame([(1, LONG), (1, LONG), (None, LONG[:500])], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_removed) for r in repeats.remove_repeats(df).collect())
    n = len(LONG.encode())
    head = len(LONG[:500].encode())
    assert got[2] == (True, 0) and got[0][1] == got[1][1] and head <= got[0][1] < n


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(3)
    v = r.standard_normal((300, 16))
    for k in range(40):
        v[100 + k] = v[k % 5] + r.standard_normal(16) * 0.25
    v[200] = v[0] * 3
    v[201:210] = v[1]
    data = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0] * 15 + [None], 1), (903, [float("nan")] * 16, 1), (904, [1.0], 1)]
    got = {x.vec_id: x for x in vecdedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.9) & ~np.eye(300, dtype=bool)
    comp = brute_components(300, zip(*np.nonzero(hit)))
    assert len(got) == len(data)
    assert sum(got[i].n_links for i in range(300)) >= 0.97 * hit.sum()
    assert sum(got[i].component_id == comp[i] for i in range(300)) >= 297
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 905))
    assert vecdedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_a_dense_third_equal_brute_force(spark):
    r = np.random.default_rng(8)
    n, dim = 9000, 64
    v = r.standard_normal((n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    center = v[0].copy()

    def off(base, cosine):
        x = r.standard_normal(dim)
        x -= (x @ base) * base
        return cosine * base + np.sqrt(1 - cosine**2) * x / np.linalg.norm(x)

    for i in range(n // 3):
        v[i] = off(center, np.sqrt(0.8))  # mutual cosines of about 0.8
    for i in range(0, 600, 2):
        v[i + 1] = off(v[i], 0.905)
        v[n // 2 + i + 1] = off(v[n // 2 + i], 0.905)
    got = {x.vec_id: x for x in vecdedup.near_duplicates(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.9) & ~np.eye(n, dtype=bool)
    dense = hit[: n // 3, : n // 3].sum()
    assert sum(got[i].n_links for i in range(n // 3)) >= 0.95 * dense and sum(x.n_links for x in got.values()) >= 0.95 * hit.sum()


def test_vectors_of_every_length_and_over_many_partitions(spark):
    r = np.random.default_rng(11)
    v = r.standard_normal((500, 16))
    v[250:] = v[:250] + r.standard_normal((250, 16)) * 0.4
    short = r.standard_normal((40, 8))
    short[20:] = short[:20] + r.standard_normal((20, 8)) * 0.05
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + i, x.tolist()) for i, x in enumerate(short)] + [(2000, [1.0, 2.0]), (2001, [1.0, 2.0]), (2002, [3.0])]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {x.vec_id: x for x in vecdedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for first, x in ((0, v), (1000, short)):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        hit = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
        assert sum(got[first + i].n_links for i in range(len(x))) >= 0.97 * hit.sum()
    assert [(got[i].n_links, got[i].component_id) for i in (2000, 2001, 2002)] == [(1, 2000), (1, 2000), (0, 2002)]


def test_lm_scores_equal_brute_force(spark, empty):
    data = [(i, prose(random.randint(0, 30))) for i in range(40)] + [(50, None), (51, ""), (51, ""), (52, "A a A")]
    got = sorted(map(tuple, lmscore.score_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()))
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split() for _, t in data]
    total = sum(map(len, words))
    want = []
    for k, (i, _) in enumerate(data):
        one, two = defaultdict(int), defaultdict(int)
        for j, w in enumerate(words):
            if j != k:
                for x, y in zip([None, *w], w):
                    one[y] += 1
                    two[x, y] += x is not None
        n, score = total - len(words[k]), 0
        for x, y in zip([None, *words[k]], words[k]):
            s = two[x, y] / one[x] if two[x, y] else max(one[y], 0.5) / n * (0.4 if x is not None else 1)
            score += round(1e6 * np.log10(s))
        want.append((i, len(words[k]), score))
    assert all(g[:2] == w[:2] and abs(g[2] - w[2]) <= 1 for g, w in zip(got, sorted(want), strict=True))
    assert lmscore.score_documents(empty).count() == 0
    assert lmscore.score_documents(spark.createDataFrame([(1, "alone here")], "doc_id long, text string")).first().score_micro == 0


def wav(x, rate=4000):
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((x * 12000).astype("<i2").tobytes())
    return f.getvalue()


def tune(seed, n=120, rate=4000):
    r = np.random.default_rng(seed)
    t = np.arange(256) / rate
    return np.concatenate([np.sin(2 * np.pi * 261.6 * 2 ** (k / 12) * t) for k in r.integers(0, 12, n)])


def test_fingerprints_use_all_their_bits():
    code = media.fingerprint(tune(5, 3000), 4000)
    assert len(np.unique(code)) > 0.9 * len(code)
    assert all(0.02 < ((code >> np.uint32(b)) & np.uint32(1)).mean() < 0.98 for b in range(32))


def test_recordings_align(spark):
    a, b = tune(1), tune(2)
    noisy = a + np.random.default_rng(0).standard_normal(len(a)) * 0.01
    late = np.concatenate([tune(3, 5), a])
    data = [(1, wav(a)), (2, wav(b)), (3, wav(noisy)), (4, wav(late)), (5, wav(a)), (6, None), (7, b"junk"), (8, wav(a[:300])), (9, wav(np.zeros(30000)))]
    got = {r.id: r for r in media.align_recordings(spark.createDataFrame(data, "id long, media binary")).collect()}
    assert [got[i].group_id for i in range(1, 10)] == [1, 2, 1, 1, 1, 6, 7, 8, 9]
    assert got[4].offset == -5 and got[5].offset == 0 and got[3].bit_errors < 0.15
    assert got[6].n_codes == got[7].n_codes == got[8].n_codes == 0
    assert media.align_recordings(spark.createDataFrame([], "id long, media binary")).count() == 0


def test_histogram_counts_all_equal_places():
    r = np.random.default_rng(4)
    for values in (2, 9, 500):
        a, b = r.integers(0, values, 300).astype(np.uint32), r.integers(0, values, 170).astype(np.uint32)
        want = [int(sum(a[j + d] == b[j] for j in range(170) if 0 <= j + d < 300)) for d in range(-169, 300)]
        assert media._histogram(a, b).tolist() == want


def test_noisy_copies_excerpts_and_lead_ins_align(spark, monkeypatch):
    """Fingerprints with wrong bits stand in for re-encoded recordings: each group has one base and what was made of it."""
    r = np.random.default_rng(6)

    def noisy(code, share):
        flips = (r.random((len(code), 32)) < share) @ (np.uint64(1) << np.arange(32, dtype=np.uint64))
        return code ^ flips.astype(np.uint32)

    made, group = {}, {}
    for k in range(12):
        base = media.fingerprint(tune(100 + k, 400), 4000)
        lead = media.fingerprint(tune(200 + k, 150), 4000)
        first = len(made)
        for code in (base, noisy(base, 0.005), noisy(base, 0.02), noisy(base, 0.05), base[90:190], noisy(base[200:], 0.03), np.concatenate([lead, base])):
            group[len(made)] = first
            made[len(made)] = code
    for k in range(30):
        group[len(made)] = len(made)
        made[len(made)] = media.fingerprint(tune(300 + k, 60 + 20 * k), 4000)
    codes = [(i, c.astype("<u4").tobytes()) for i, c in made.items()]
    monkeypatch.setattr(media, "fingerprints", lambda df, i, m: df.select(F.col(i).alias("id"), F.col(m).alias("codes")))
    got = {x.id: x for x in media.align_recordings(spark.createDataFrame(codes, "id long, media binary")).collect()}
    assert {i: x.group_id for i, x in got.items()} == group
    assert all(got[k].offset == 90 and got[k + 1].offset == 200 and got[k + 2].offset == len(made[k - 4]) - len(made[k + 2]) for k in range(4, 84, 7))


def _flipped(r, code, share):
    return code ^ ((r.random((len(code), 32)) < share) @ (np.uint64(1) << np.arange(32, dtype=np.uint64))).astype(np.uint32)


def test_candidates_reach_the_bit_errors_that_links_allow(spark):
    """Pairs with independent wrong bits, up to the most that a link may have, become candidates at their true offset."""
    r, rows, pairs = np.random.default_rng(11), [], {}
    for frames in (16, 30, 60, 120):
        for share in (0.1, 0.12, 0.15):
            for _ in range(150):
                code = r.integers(0, 1 << 32, frames, dtype=np.uint32)
                lead = r.integers(0, 1 << 32, 40, dtype=np.uint32)
                pairs[len(rows)] = frames, share
                rows += [(len(rows), code.tobytes()), (len(rows) + 1, np.concatenate([lead, _flipped(r, code, share)]).tobytes())]
    found = media._candidates(Scratch(spark, "test"), spark.createDataFrame(rows, "id long, codes binary")).collect()
    hit = {x.a for x in found if x.b == x.a + 1 and x.a in pairs and -40 in x.hints}
    for key in set(pairs.values()):
        of_key = [i for i, k in pairs.items() if k == key]
        assert sum(i in hit for i in of_key) >= 0.9 * len(of_key), key
    assert len(found) < 1.01 * len(pairs)


def _met(codes):
    parts = [media._rows(i, c, t, np.zeros(0, np.uint64), np.zeros(0, np.int64)) for i, c in enumerate(codes) for t in range(media.TURNS)]
    cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.argsort(cols[0], kind="stable")
    spot, ids, place, size, *sides = (x[order] for x in cols)
    return media._meetings(spot, ids, place.astype(np.int64), size.astype(np.int64), [v.view(np.uint64) for v in sides])


def test_unrelated_recordings_seldom_meet(monkeypatch):
    """Tunes of the same 12 notes agree in many places by chance; their wider surroundings do not."""
    codes = [media.fingerprint(tune(1000 + k, 300), 4000) for k in range(200)]
    codes.append(_flipped(np.random.default_rng(13), codes[7], 0.1))
    met = _met(codes)
    assert (7, 200, 0) in {tuple(x[:3].tolist()) for x in met} and len(met) < 20
    for most in (1, 1 << 40):  # all as tables, none
        monkeypatch.setattr(media, "TABLE", most, raising=False)
        assert np.array_equal(_met(codes), met)


def test_bits_that_many_places_share_are_dealt_over_blocks(spark, monkeypatch):
    r = np.random.default_rng(12)
    common = r.integers(0, 1 << 32, 60, dtype=np.uint32)
    rows = [(i, np.concatenate([r.integers(0, 1 << 32, i % 7, dtype=np.uint32), _flipped(r, common, 0.03)]).tobytes()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, codes binary")
    whole = {(x.a, x.b, tuple(sorted(x.hints))) for x in media._candidates(Scratch(spark, "test"), df).collect()}
    monkeypatch.setattr(media, "BLOCK", 4)
    assert len(media._hot_keys(df)[0]) > 0
    dealt = {(x.a, x.b, tuple(sorted(x.hints))) for x in media._candidates(Scratch(spark, "test"), df).collect()}
    assert dealt == whole and len(whole) == 60 * 59 // 2


def test_shingles_count_words_as_stated():
    w, bounds = word_hashes(["a b c d e f", "A\x0bB", "", "x"])
    assert [len(s) for s in shingles(w, bounds, 5)] == [2, 1, 0, 1] and np.diff(bounds).tolist() == [6, 2, 0, 1]
