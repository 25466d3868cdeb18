"""Golden expectations against a plain loop: compatibility forms, case folding, empty and many fragments."""

import random

from keyloom.operators import golden


def plain(rows, expected, modes):
    out = set()
    for case, platform, kind, value in expected:
        if modes.get(case) not in ("both", platform):
            continue
        own = [r for r in sorted(rows, key=lambda r: r[1]) if r[0] == case and r[2] != "negative" and r[4 if platform == "naver_sa" else 5]]
        forms = [golden.normal(r[3]) for r in own]
        firsts = [r[3] for i, r in enumerate(own) if forms[i] not in forms[:i]]
        v = golden.normal(value)
        if kind == "must_keep" and v not in forms:
            out.add((case, platform, "missing_must_keep", value))
        if kind == "must_not_emit":
            out |= {(case, platform, "emitted_forbidden_keyword", k) for k in firsts if golden.normal(k) == v}
        if kind == "forbidden_substrings":
            out |= {(case, platform, "emitted_forbidden_substring", k) for k in firsts if v in golden.normal(k)}
        if kind == "required_categories" and value not in {r[2] for r in own}:
            out.add((case, platform, "missing_category", value))
    return out


def test_normal_form():
    assert golden.normal(" Ａｃｍｅ|Straße/ＭＡＳＫ_x ") == "acme strasse mask x" and golden.normal(None) == "" and golden.normal("ﬁt") == "fit"


def test_findings_equal_a_plain_loop(spark):
    r = random.Random(6)
    words = ["Acme", "ＡＣＭＥ", "mask", "Straße", "strasse", "크림", "a_b", "a b", "ba"]
    text = lambda: " ".join(r.choices(words, k=r.randint(1, 3)))
    rows = [(f"c{c}", o, r.choice(["brand", "long_tail", "negative"]), text(), r.choice(["", "완전일치"]), r.choice(["", "exact"])) for c in range(8) for o in range(12)]
    expected = [(f"c{r.randint(0, 9)}", r.choice(["naver_sa", "google_sa"]), r.choice([*golden.KINDS]), r.choice([text(), "brand", "season_event", "m", "asse a", ""])) for _ in range(150)]
    modes = {f"c{i}": r.choice(["both", "naver_sa", "google_sa"]) for i in range(10)}
    df = spark.createDataFrame(rows, "url string, ord int, category string, keyword string, naver_match string, google_match string")
    want = spark.createDataFrame(expected, "case_id string, platform string, kind string, value string")
    mode = spark.createDataFrame([*modes.items()], "case_id string, mode string")
    for most in (golden.MOST_FRAGMENTS, 2):  # the automaton, and the index beyond its bound
        got = [tuple(x) for x in golden.findings(df, want, mode, most).collect()]
        assert set(got) == plain(rows, expected, modes) and len(got) == len(set(got))
    assert {x[2] for x in got} == set(golden.KINDS.values())
    assert golden.findings(df, want.limit(0)).count() == 0 and golden.findings(df.limit(0), want.where("kind = 'forbidden_substrings'")).count() == 0
