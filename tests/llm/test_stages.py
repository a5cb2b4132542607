"""The pipeline's stages: odd tables, clashing names, repeated rows, and the whole against plain versions of each stage."""

import random
from collections import Counter

import pytest

from tests.llm.test_llm import brute_roots, files, prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")
NAMES = "target long, s string, won string, symbols_high double, source_size long, whole int, cut long, rest long, place long, class string, row long, _at long, _src string, _class int, _row int, features string, kept string"
DOC = f"doc_id long, text string, lang string, source string, n_chars long, {NAMES}"
CLASH = (1, "s", "w", 0.5, 2, 3, 4, 5, 6, "c", 7, 8, "x", 9, 10, "f", "k")


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), *CLASH)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    clean = [doc(100 + i, prose(rng, 90), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(40)]
    odd = [doc(1, None), doc(2, ""), doc(3, " \n\t "), doc(4, "one two"), doc(5, prose(rng, 30_000)), doc(6, prose(rng, 60), None, None), (9, *[None] * 21)]
    twice = [doc(11, prose(rng, 50))] * 2 + [doc(None, prose(rng, 50))] * 2
    same_id = [doc(7, clean[0][1]), doc(7, prose(rng, 55)), doc(3, clean[0][1])]
    return clean + odd + twice + same_id + [doc(12, prose(rng, 40) + ' pwd: "gT7#qLw9!rB2" ' + prose(rng, 20))]


def test_stages_with_odd_rows_and_names(spark, rows):
    df = spark.createDataFrame(rows, DOC)
    whole = Counter(map(repr, rows))
    stages = dict(corpus_pipeline.STAGES)
    text = lambda r: len((r.text or "").split())
    for name, stage in list(stages.items())[:4]:
        out = stage(spark, df, "")
        assert out.columns == df.columns and stage(spark, df.limit(0), "").count() == 0, name
        got = [tuple(r) for r in out.collect()]
        if name == "quality rules":
            assert not Counter(map(repr, got)) - whole and all(len((r[1] or "").split()) >= 20 for r in got) and len(got) >= 45
        if name == "n-gram Jaccard join":
            left = Counter(map(repr, got))
            assert not left - whole and sum((whole - left).values()) == 4  # a repeated row of 11, one without id, 7's and 100's copy
            assert {r[0] for r in got if r[1] == rows[0][1]} == {3} and sum(r[0] == 7 for r in got) == 1 and sum(r[0] == 11 for r in got) == 1
            assert {1, 2, 9} <= {r[0] for r in got} and sum(r[0] is None for r in got) == 1
        if name == "secret scans":
            changed = [r for r in got if repr(r) not in whole]
            assert len(got) == len(rows) and [(r[0], "[SECRET]" in r[1], r[4] == len(r[1])) for r in changed] == [(12, True, True)]
        if name == "mixing sources to target weights":
            words = sum(map(text, df.collect()))
            longest = max(map(text, df.collect()))
            assert set(map(repr, got)) <= set(whole) and abs(sum(len((r[1] or "").split()) for r in got) - 1.5 * words) <= 4 * longest
    pieces = stages["packing"](spark, df, "").collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(r[0] for r in rows) and stages["packing"](spark, df.limit(0), "").count() == 0


def test_run_against_plain_stages(spark, tmp_path):
    """Unique ids, so each stage's rows can be found with DuckDB and Python alone."""
    import duckdb

    from tessera.llm import packing, secrets
    from tessera.llm.mixing import OP7_SQL
    from tessera.llm.quality import OP9_SQL

    rng = random.Random(5)
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    docs += [(1000 + i, t + " tail", g, s, len(t) + 5) for i, (_, t, g, s, _) in enumerate(docs[:20]) if t]
    docs += [(2000, prose(rng, 40) + " pwd: gT7#qLw9!rB2", "en", "a", 0), (2001, None, None, None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, kind).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    def sql(query, table):
        import pyarrow as pa

        con = duckdb.connect()
        con.register("documents", pa.table([list(c) for c in zip(*table, strict=True)], names=[x.split()[0] for x in kind.split(", ")]))
        out = con.sql(query)
        return [dict(zip(out.columns, r, strict=True)) for r in out.fetchall()]

    kept = {r["doc_id"] for r in sql(OP9_SQL, docs) if r["kept"]}
    docs = [d for d in docs if d[0] in kept]
    first: dict = {}
    for (i, *_), root in sorted(zip(docs, brute_roots([d[:2] for d in docs]), strict=True)):
        first.setdefault(root, i)
    docs = [d for d in docs if d[0] in set(first.values())]
    clear = []
    for i, text, *rest in docs:
        for _, a, b, _ in reversed(secrets.scan(text)):
            text = text[:a] + "[SECRET]" + text[b:]
        clear.append((i, text, *rest[:2], len(text)))
    times = Counter()
    for r in sql(OP7_SQL, clear):
        times[r["doc_id"]] = r["taken"] // r["size"] + (2 * (r["taken"] % r["size"]) >= r["size"])
    want = Counter({i: n for i, n in times.items() if n})
    assert Counter(r.doc_id for r in got if r.start == 0) == want
    sizes = {i: len(packing.token_ids(t, *files())) + 1 for i, t, *_ in clear}
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
        assert r.doc_tokens == sizes[r.doc_id]
    assert total == Counter({i: n * sizes[i] for i, n in want.items()})


def test_tables_of_the_stage_before_go(spark, rows, tmp_path):
    from tessera.llm import common

    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality rules"](spark, spark.createDataFrame(rows, DOC), "")
    before = corpus_pipeline._left[0]
    assert before and before <= common.written()
    lazy = stages["secret scans"](spark, first, "")  # reads them still
    assert before <= common.written() and lazy.count() > 0
    first.write.parquet(f"{tmp_path}/kept")
    corpus_pipeline._left[0] = before
    assert stages["secret scans"](spark, spark.read.parquet(f"{tmp_path}/kept"), "").count() > 0 and not before & common.written()
