"""K-d tree shards: equal texts together, sizes near equal, and cuts against a tree in plain Python."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import sharding

DOC = "doc_id long, text string, lang string, source string, g string, v0 int, shard string, node int, bytes string"


def rows_of(rng, n, copies=()):
    texts = [" ".join(rng.choice("river stone cloud green".split()) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 60))) for _ in range(n)]
    for k, times in enumerate(copies):
        texts += [f"copy {k} " + "word " * 30] * times
    return [(i, t, rng.choice(["en", "de", None]), rng.choice("abc"), "x", 1, "y", 2, "z") for i, t in enumerate(texts)]


def check(got, rows, shards):
    of, size, slots, text = defaultdict(set), Counter(), defaultdict(list), {r[0]: r[1] for r in rows}
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        of[raw].add(r.shard)
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(size) <= set(range(shards))
    return of, size


def test_equal_texts_stay_together(spark):
    rng = random.Random(6)
    rows = rows_of(rng, 1500, (60, 30, 7, 2, 2, 3))
    of, size = check(sharding.kd_shards(spark.createDataFrame(rows, DOC), shards=24).collect(), rows, 24)
    assert all(len(s) == 1 for s in of.values()) and len(size) == 24
    target = sum(size.values()) / 24
    assert max(size.values()) < 1.15 * target and min(size.values()) > 0.85 * target


def test_a_group_of_more_than_a_shard_is_cut(spark):
    rng = random.Random(7)
    rows = rows_of(rng, 600, (1200, 40))
    of, size = check(sharding.kd_shards(spark.createDataFrame(rows, DOC), shards=16).collect(), rows, 16)
    cut = [s for s in of.values() if len(s) > 1]
    assert len(cut) == 1 and len(cut[0]) <= 16
    target = sum(size.values()) / 16
    assert max(size.values()) < 1.2 * target and min(size.values()) > 0.8 * target


def brute_tree(groups, capacities):
    """Leaves over groups (g, bytes, values): split at the weighted quantile along the widest dimension."""
    mask = (1 << sharding.TEXT_BITS) - 1
    width = [max(g[2][i] for g in groups) - min(g[2][i] for g in groups) for i in range(3)]
    out = {}

    def split(part, first, n):
        if n == 1 or not part:
            out.update({g[0]: first for g in part})
            return
        spread = [(max(g[2][i] for g in part) - min(g[2][i] for g in part)) / max(1, width[i]) for i in range(3)]
        axis = spread.index(max(spread))
        part.sort(key=lambda g: (g[2][axis], g[0] & mask))
        half = n // 2
        want = sum(g[1] for g in part) * sum(capacities[first : first + half]) / (sum(capacities[first : first + n]) or 1)
        upto = 0
        for k, g in enumerate(part):
            upto += g[1]
            if upto >= want:
                k += 2 * (want - upto + g[1]) >= g[1]
                break
        split(part[:k], first, half)
        split(part[k:], first + half, n - half)

    split(groups, 0, len(capacities))
    return out


@pytest.mark.parametrize("shards", [2, 5, 24])
def test_cuts_against_plain_python(spark, shards):
    rng = random.Random(shards)
    groups = [(rng.randrange(-(1 << 63), 1 << 63), rng.randrange(8, 5000), (rng.randrange(20), rng.choice([0, 7, 900]), rng.randrange(3))) for _ in range(700)]
    capacities = [rng.choice([0.0, 1.0, 1.0, 2.5]) for _ in range(shards - 1)] + [1.0]
    df = spark.createDataFrame([(g, b, *v) for g, b, v in groups], "g long, bytes long, v0 long, v1 long, v2 long")
    got = {r.g: r.shard for r in sharding._tree(df, range(3), capacities).collect()}
    assert got == brute_tree(list(groups), capacities)


def test_capacities():
    assert sharding._capacities([0, 0], 10) == [5, 5]
    assert sharding._capacities([4, 0], 10) == [3, 7]
    assert sharding._capacities([40, 0, 2], 10) == [0, 6, 4]
    assert math.isclose(sum(sharding._capacities([7, 3, 9, 1], 5)), 5)


def test_odd_tables(spark):
    rng = random.Random(8)
    rows = rows_of(rng, 30) + [(None, None, None, None, None, None, None, None, None), (None, "", "en", "a", "", 0, "", 0, ""), (77, "é" * 200_000, "en", "a", "", 0, "", 0, "")] + [(78, "same", "en", "a", "", 0, "", 0, "")] * 2
    df = spark.createDataFrame(rows, DOC)
    got = sharding.kd_shards(df, shards=24).collect()
    assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert len({r.shard for r in got if r.doc_id == 78}) == len({r.shard for r in got if r.doc_id is None}) == 1
    assert sharding.kd_shards(df.limit(0), shards=24).count() == 0 and sharding.kd_shards(df.limit(0), target_bytes=10).count() == 0
    assert sharding.kd_shards(df, target_bytes=100_000).select("shard").distinct().count() > 1
    assert sharding.kd_shards(df, shards=1).select("shard").distinct().count() == 1
