"""Secret scans: fixed patterns, and password guess costs of values in credential contexts."""

from __future__ import annotations

import base64
import math
import re
from functools import lru_cache
from itertools import islice, takewhile

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, prepare

# The base patterns, and the least length of what counts.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGN, MIN_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "guess")

#: Contexts whose values are judged by guess cost: assignments to credential names, and the password of a url.
CONTEXT = re.compile(
    r"(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|credentials?)[\"']?[\x20\t]*+(?::=|=>|[:=])[\x20\t]*+(?:\"([^\"\n]{4,})\"|'([^'\n]{4,})'|([^\s\"'<>,;]{4,}))"
    r"|bearer[\x20\t]++([A-Za-z0-9+/_.=~-]{4,})|://[^\s/:@]{1,64}:([^\s/@]{4,})@",
    re.I | re.A,
)
#: Java pattern of a text that may hold anything of the above; others never leave the JVM.
MAY_HOLD = r"(?i:passw|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|credential|bearer)|AKIA|[0-9a-f]{32}|://[^\s/:@]{1,64}:[^\s/@]{4}"
#: log10 of the guesses from which a value in such a context is a secret.
MIN_COST = 10.0

# Frequent passwords and parts of them, most frequent first.
COMMON = (
    "password 123456 12345678 qwerty 111111 abc123 letmein monkey dragon master iloveyou sunshine princess football "
    "baseball welcome admin login shadow superman michael jennifer jordan hunter killer trustno1 batman thomas summer "
    "winter spring autumn secret access flower hello charlie freedom whatever cheese computer internet starwars test "
    "guest root user changeme default example sample placeholder none null your here token key pass word demo temp love "
    "god sex money time good house office home work red blue green black white orange yellow silver gold"
).split()
LEET = str.maketrans("4@301!$5+7", "aaeoiisstt")
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")

_KEYS = {c: (r, i + r / 2) for r, row in enumerate(KEY_ROWS) for i, c in enumerate(row)}
_NEXT = {a + b for a in _KEYS for b in _KEYS if a != b and abs(_KEYS[a][0] - _KEYS[b][0]) <= 1 and abs(_KEYS[a][1] - _KEYS[b][1]) <= 1}
_WALK_START, _WALK_STEP, _RUN_START, _RUN_STEP = math.log10(47), math.log10(3.5), math.log10(20), 0.1
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")
_LONGEST_PERIOD, _SEGMENT, _VARIED, _SHORTEST = 8, 0.3, 0.6, 3
#: Characters up to which a value's cost is remembered.
_REMEMBERED = 256


@lru_cache(2)
def word_ranks(path: str) -> tuple[dict[str, int], frozenset[str], int]:
    """Words by rank, their first letters, and the longest's length: COMMON, and then the words of the vocabulary file at
    ``path`` (a token of a space and three letters or more), whose order of merges follows their frequency."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f]
    words = dict.fromkeys([*COMMON, *(t[1:].decode().lower() for t in tokens if re.fullmatch(rb" [A-Za-z]{3,}", t))])
    return {w: i + 1 for i, w in enumerate(words)}, frozenset(w[:_SHORTEST] for w in words), max(map(len, words))


def default_words() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _brute(c: str) -> float:
    """log10 of the alphabet that a character stands for."""
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


def guess_cost(value: str, words: str | None = None) -> float:
    """log10 of the guesses of the cheapest segmentation into words, dates, repeats, keyboard walks and brute force.

    ``words``: the vocabulary file of ``word_ranks``. Letters that are no listed word cost as brute force.
    """
    path = words or default_words()
    return _remembered(value, path) if len(value) <= _REMEMBERED else _cost(value, path)


def _cost(value: str, path: str) -> float:
    """``best[j]`` is the least cost of the first j characters; a segment adds its own cost and a constant for the cut.
    Brute force, walks and runs of successive characters cost a sum over characters, so each carries one state along;
    words, dates and repeats are whole segments. Time is linear in the length, whatever the value."""
    ranks, heads, longest = word_ranks(path)
    n = len(value)
    low, plain = value.lower(), value.lower().translate(LEET)
    if len(low) != n:
        low = plain = value
    segments: dict[int, list[tuple[int, float]]] = {}  # by end: start, cost
    put = lambda start, end, cost: segments.setdefault(end, []).append((start, cost))
    for text in (low, plain) if plain != low else (low,):
        for i in range(n - _SHORTEST + 1):
            if text[i : i + _SHORTEST] in heads:
                for j in range(i + _SHORTEST, min(n, i + longest) + 1):
                    if rank := ranks.get(text[i:j]):
                        put(i, j, math.log10(rank + 1) + _VARIED * ((text[i:j] != low[i:j]) + (value[i:j] != low[i:j])))
    for m in _DATE.finditer(value):
        put(m.start(), m.end(), math.log10(120) + (m.end() - m.start() > 4) * math.log10(365))
    for period in range(1, min(_LONGEST_PERIOD, n // 2) + 1):
        start = 0
        for i in range(period, n + 1):
            if i == n or value[i] != value[i - period]:
                times = (i - start) // period
                if times >= 2 and times * period >= 3:
                    block = value[start : start + period]
                    cost = guess_cost(block, path) if period > 2 else sum(map(_brute, block))
                    put(start, start + times * period, cost + math.log10(times))
                start = i - period + 1
    inf = math.inf
    best = [0.0] + [inf] * n
    brute = walk = run = inf
    step = 0
    for j in range(1, n + 1):
        brute = min(brute, best[j - 1] + _SEGMENT) + _brute(value[j - 1])
        choices = [brute]
        if j > 1 and low[j - 2 : j] in _NEXT:
            walk = min(walk, best[j - 2] + _SEGMENT + _WALK_START) + _WALK_STEP
            choices.append(walk)
        else:
            walk = inf
        d = ord(low[j - 1]) - ord(low[j - 2]) if j > 1 else 0
        if d in (1, -1):
            run = min(run if d == step else inf, best[j - 2] + _SEGMENT + _RUN_START) + _RUN_STEP
            choices.append(run)
        else:
            run = inf
        step = d
        choices += [best[i] + _SEGMENT + cost for i, cost in segments.get(j, ())]
        best[j] = min(choices)
    return max(0.0, best[n] - _SEGMENT) if n else 0.0


_remembered = lru_cache(20_000)(_cost)


def scan(text: str, words: str | None = None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, log10 guesses) by start, then kind as listed in KINDS.

    Base spans cover whole matches. A value in a credential context that touches no base span and costs at least
    MIN_COST is a span of the kind ``guess``.
    """
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    out = [(kind, a, b, guess_cost(value, words)) for kind, a, b, value in found]
    taken = sorted((a, b) for _, a, b, _ in out)
    k = 0
    for m in CONTEXT.finditer(text):
        a, b = m.span(m.lastindex)
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if not any(x < b and a < y for x, y in takewhile(lambda t: t[0] < b, islice(taken, k, None))) and (cost := guess_cost(m[m.lastindex], words)) >= MIN_COST:  # noqa: B023
            out.append(("guess", a, b, cost))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPAN = "array<struct<kind:string,start:long,end:long,cost:double>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))


def _scan(words: str):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([t and [dict(zip(("kind", "start", "end", "cost"), s, strict=True)) for s in scan(t, words)] for t in texts.to_pylist()], _SPAN)

    return run


def _redact(words: str):
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            end, parts = 0, []
            for _, a, b, _ in scan(t, words) if t else ():
                if b > end:
                    if a >= end:
                        parts += [t[end:a], "[SECRET]"]
                    end = b
            out.append(t and "".join(parts) + t[end:])
        return pa.array(out, pa.string())

    return run


def _candidate(text: str) -> Column:
    """The text where it may hold a secret, else null: only such texts go to Python."""
    return F.when(F.col(text).rlike(MAY_HOLD), F.col(text))


def with_secrets(docs: DataFrame, text: str = "text", to: str = "secrets", words: str | None = None) -> DataFrame:
    """Adds the spans found in each whole text as an array of (kind, start, end, cost), in code points.

    Null and empty texts hold none; every row is judged for itself, so ties, repeated rows, null ids and extra columns
    change nothing; an empty table stays empty. ``to`` replaces a column of that name. ``words``: see ``word_ranks``.
    """
    prepare(docs.sparkSession)
    return docs.withColumn(to, F.coalesce(F.arrow_udf(_scan(words or default_words()), SPAN)(_candidate(text)), F.array().cast(SPAN)))


def redacted(docs: DataFrame, text: str = "text", words: str | None = None) -> DataFrame:
    """Puts ``[SECRET]`` in the place of each (merged) span; a column n_chars follows. Null texts stay null, empty ones
    empty; every row is redacted for itself, so ties, repeated rows and null ids change nothing; other columns, whatever
    their names, pass through; an empty table stays empty."""
    prepare(docs.sparkSession)
    out = docs.withColumn(text, F.coalesce(F.arrow_udf(_redact(words or default_words()), "string")(_candidate(text)), F.col(text)))
    return out.withColumn("n_chars", F.when(F.col(text).isNotNull(), F.length(text)).cast("long")) if "n_chars" in docs.columns else out


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_secrets(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return df.select(
        "doc_id", *map(count, KINDS[:3]),
        F.sha2(joined(F.filter("secrets", lambda x: x["kind"] != "guess")), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        F.array_max(F.transform("secrets", lambda x: x["cost"])).alias("max_cost"),
    )
