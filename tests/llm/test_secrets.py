"""Guess costs against a plain reference, and spans and counts against the contract's patterns."""

import hashlib
import math
import random
import re
from collections import Counter

from tessera.llm import secrets as S

DOC = "doc_id long, text string, lang string, source string, n_chars long, secrets string, spans string, _text int"


def reference_cost(value: str) -> float:
    """All segmentations: the cost of every (start, end) by its cheapest kind, and the least sum."""
    ranks, _, _ = S.word_ranks(S.default_words())
    n, low = len(value), value.lower()
    plain = low.translate(S.LEET)
    cost = {}

    def offer(i, j, c):
        cost[i, j] = min(c, cost.get((i, j), math.inf))

    dates = {m.span() for m in S._DATE.finditer(value)}
    for i in range(n):
        for j in range(i + 1, n + 1):
            part = low[i:j]
            offer(i, j, sum(map(S._brute, value[i:j])))
            for written in {part, plain[i:j]}:
                if len(part) >= 3 and written in ranks:
                    offer(i, j, math.log10(ranks[written] + 1) + 0.6 * ((written != part) + (value[i:j] != part)))
            if (i, j) in dates:
                offer(i, j, math.log10(120) + (j - i > 4) * math.log10(365))
            steps = [ord(b) - ord(a) for a, b in zip(part, part[1:], strict=False)]
            if steps and (set(steps) == {1} or set(steps) == {-1}):
                offer(i, j, math.log10(20) + 0.1 * len(steps))
            if steps and all(part[k : k + 2] in S._NEXT for k in range(len(steps))):
                offer(i, j, math.log10(47) + len(steps) * math.log10(3.5))
            for p in range(1, 9):
                same = lambda k, p=p: 0 <= k < n - p and value[k] == value[k + p]
                if (j - i) % p == 0 and j - i >= max(3, 2 * p) and all(same(k) for k in range(i, j - p)) and not same(i - 1):
                    end = next(k for k in range(j, n + 1) if k == n or value[k] != value[k - p])
                    if j == i + (end - i) // p * p:
                        offer(i, j, (reference_cost(value[i : i + p]) if p > 2 else sum(map(S._brute, value[i : i + p]))) + math.log10((j - i) // p))
    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        best[j] = min(best[i] + cost[i, j] + 0.3 for i in range(j) if (i, j) in cost)
    return max(0.0, best[n] - 0.3)


def test_reference_costs():
    rng = random.Random(1)
    parts = ["password", "River", "p4ssw0rd", "1990-12-31", "31121990", "2001", "qwerty", "asdf", "zxcvb", "abcdef", "4321", "aaaa", "xyxyxy", "ab1ab1ab1", "Kq7#", "é", "z", "9", "-", "monkey", "7ime"]
    for _ in range(400):
        value = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))
        assert math.isclose(S.guess_cost(value), reference_cost(value), abs_tol=1e-9), value
    for _ in range(200):
        value = "".join(rng.choice("ab1q2wS#e") for _ in range(rng.randrange(0, 14)))
        assert math.isclose(S.guess_cost(value), reference_cost(value), abs_tol=1e-9), value


def test_unlisted_letters_cost_as_brute_force():
    rng = random.Random(2)
    found = 0
    for _ in range(500):
        value = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
        found += [k for k, *_ in S.scan(f"pwd: {value}")] == ["guess"]
    assert found >= 498
    for text in ("pwd: window", "access_key: Garden", "bearer morning", "passphrase: quietriver", "passcode: 19901231", "pwd: qwertyuiop"):
        assert S.scan(text) == [], text


def test_long_values_take_linear_time():
    rng = random.Random(5)
    value = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(200_000))
    assert S.guess_cost(value) > 200_000 and S._remembered.cache_info().maxsize * S._REMEMBERED < 1 << 24


def brute_base(text):
    out = []
    for m in re.finditer(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_query_against_brute_force(spark):
    from tessera.llm import registry

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = registry.queries()["op1_secret_scan"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_base(texts[r.doc_id])
        n = Counter(k for _, _, k, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        joined = [f"{k}:{a}:{b}" for a, _, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("guess")] == joined
    assert sum(r.n_assign + r.n_hex + r.n_access for r in rows) > 0


def test_odd_rows_with_secrets(spark):
    """Nulls, empty and long texts, repeats, clashing names: each row's spans are its own."""
    secret = "é pwd: gT7#qLw9!rB2 end"
    long = "word " * 100_000 + "password=hunter2hunter2 " + "word " * 10
    rows = [(1, secret, None, None, None, "x", "y", 1)] * 2 + [(None, secret, "en", "s", 3, None, None, None), (2, None, None, None, None, None, None, None), (3, "", "", "", 0, "", "", 0), (4, long, "en", "s", 1, "", "", 0)]
    df = spark.createDataFrame(rows, DOC)
    got = Counter((r.doc_id, *[(s.kind, s.start, s.end) for s in r.secrets]) for r in S.with_secrets(df).collect())
    assert got == Counter({(1, ("guess", 7, 19)): 2, (None, ("guess", 7, 19)): 1, (2,): 1, (3,): 1, (4, ("assign", 500_000, 500_023)): 1})
    out = S.redacted(df)
    assert out.columns == df.columns and Counter(r.text for r in out.collect())["é pwd: [SECRET] end"] == 3
    assert {r.doc_id: (r.text, r.n_chars) for r in out.where("doc_id IN (2, 3)").collect()} == {2: (None, None), 3: ("", 0)}
    assert S.redacted(df.limit(0)).count() == S.with_secrets(df.limit(0)).count() == 0
