import random

import pytest
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.functions import text as T
from tessera.functions.dates import parse_iso, whole_days
from tessera.functions.parsing import episode_lines, episodes, json_object, label_and_description, summary_and_open
from tessera.operators.components import connected_components
from tessera.operators.conversations import conversations, project_of
from tessera.operators.graph import louvain
from tessera.sources.mailbox import header_text, new_rows, parse_message, parse_messages, update_columns


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(f(F.col("x"))).collect()]


def test_subjects(spark):
    got = one(spark, T.normalize_subject, "Re: Fwd: Plán  stavby", "VS meeting", "Re x", "Re[2]: a", None, "  ")
    assert got == ["plan stavby", "meeting", "x", "re[2]: a", "", ""]


def test_clean_body(spark):
    got = one(spark, T.clean_body, "Hello\nOn Mon, Jun 1, 2026 at 10:41 you wrote", "a\n> q\nFrom: x\nb\n-- \nsig", "x _____ From: y Original", None, "a\n\n\n\nb")
    assert got == ["Hello", "a\nb", "x", "", "a\n\nb"]


def test_email_type(spark):
    df = spark.createDataFrame([("noreply@a.example", "party"), ("a@b.example", "Beach party"), ("a@b.example", "budget"), (None, None)], "f string, s string")
    assert [r[0] for r in df.select(T.email_type(F.col("f"), F.col("s"))).collect()] == ["BULK", "SOCIAL", "WORK", "WORK"]


def test_threads_and_addresses(spark):
    df = spark.createDataFrame([("<m>", None, " <a> <b>"), ("<m>", "<r>", ""), (None, None, None)], "m string, i string, r string")
    assert [r[0] for r in df.select(T.thread_root(F.col("m"), F.col("i"), F.col("r"))).collect()] == ["<a>", "<r>", None]
    assert one(spark, T.domain, "a@B.example", "x", "a@b@c") == ["b.example", "", "b@c"]
    assert one(spark, lambda c: F.array_join(T.addresses_in(c), ","), "A@b.example, a@b.example;c@d.example", None) == ["a@b.example,c@d.example", ""]


def test_dates(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z", "2024-01-07T23:00:00Z"), ("2024-01-01T00:00:00Z", "2024-01-08T00:00:00Z"), ("bad", "2024-01-01T00:00:00Z")], "a string, b string")
    assert [r[0] for r in df.select(whole_days(parse_iso(F.col("a")), parse_iso(F.col("b")))).collect()] == [6, 7, None]


def test_parsing(spark):
    got = one(spark, json_object, '{"a": "1"}', 'text {"a": "2"} end', "none")
    assert got == [{"a": "1"}, {"a": "2"}, None]
    raw = ['{"name": "N", "desc": "D"}', "\n First\nsecond", 'x {"title": "T", "nazov": "Z", "popis": "P", "summary": "S"} y', '{"a": 1} {"label": "L"}', '{"label": "", "name": "N"} tail', 'pre {"a": {"b": 1}, "label": "deep"} x', None]
    assert [tuple(r) for r in one(spark, label_and_description, *raw)] == [("N", "D"), ("First", ""), ("Z", "P"), ('{"a": 1} {"label": "L"}', ""), ('{"label": "", "name": "N"} tail', ""), ("deep", ""), ("", "")]
    assert [tuple(r) for r in one(spark, summary_and_open, "SUMMARY: a b\nOPEN: c", "just text")] == [("a b", "c"), ("just text", "—")]
    text = "intro\n1. [2024-02-02T10:00] - 2024-01-01 | a | x y\nmore of it here\nshort\nkoniec epizod teraz\n\nEpizóda 2: 2024-03-03: y\n2024-04-04 " + "z" * 300
    assert episode_lines(text) == [{"d_from": "2024-01-01", "d_to": "2024-02-02", "desc": "x y / more of it here"}, {"d_from": "2024-03-03", "d_to": "2024-03-03", "desc": "y"}, {"d_from": "2024-04-04", "d_to": "2024-04-04", "desc": "(bez popisu)"}]
    assert len(one(spark, episodes, "2024-01-01: a", None)[0]) == 1


def test_components(spark):
    rng = random.Random(1)
    for _ in range(3):
        edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(25)]
        root = list(range(40))
        for _ in range(40):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        nodes = spark.range(40).withColumnRenamed("id", "node")
        got = connected_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r["node"]: r["component"] for r in got} == dict(enumerate(root))


def test_components_with_a_hub(spark, monkeypatch):
    from tessera.operators import components

    monkeypatch.setattr(components, "HOT", 1 << 40)
    monkeypatch.setattr(components, "FEW", 10)
    edges = spark.range(1, 3000).selectExpr("0L + 7000 AS a", "id AS b").unionAll(spark.range(5000, 5040).selectExpr("id AS a", "id + 1 AS b"))
    nodes = edges.select("a").union(edges.select("b")).distinct().withColumnRenamed("a", "node")
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    assert {r[0] for r in components.spread_edges(both).where("b = 7000").select("salt").distinct().collect()} == set(range(components.SALTS))
    got = {r["node"]: r["component"] for r in connected_components(nodes, edges).collect()}
    assert got == {i: 1 for i in [*range(1, 3000), 7000]} | {i: 5000 for i in range(5000, 5041)}


def test_conversations(spark):
    rows = [
        (1, "<1>", None, None, "2024-01-01T00:00:00Z", "a@x.example", "b@x.example", "", "Plan"),
        (2, "<2>", "<1>", None, "2024-06-01T00:00:00Z", "b@x.example", "a@x.example", "", "Other"),
        (3, "<3>", None, None, "2024-01-20T00:00:00Z", "c@x.example", "d@x.example", "", "Re: plan"),
        (4, "<4>", None, None, "2024-12-20T00:00:00Z", "e@x.example", "f@x.example", "", "Plan"),
        (5, "<5>", None, "<9> <4>", None, "g@x.example", "", "", ""),
    ]
    df = spark.createDataFrame(rows, "id long, message_id string, in_reply_to string, references string, date string, from_address string, to_addresses string, cc_addresses string, subject string")
    got, counts = conversations(df)
    ids = {r["id"]: r["conversation_id"] for r in got.collect()}
    assert ids[1] == ids[2] == ids[3] and ids[4] == ids[5] != ids[1] and counts == {"header_merges": 2, "subj_merges": 1}


def test_projects(spark):
    config = EngineConfig(name_rules=(("alpha", "A"), ("beta", "B"), ("am1", "Xm"), ("ab1", "Xb")), code_rules=(("1234", "C"),), cluster_rules=(("sites", "S"),))
    s = spark.createDataFrame([(1, "alpha beta"), (1, "beta"), (1, "beta 2"), (5, "beta"), (5, "alpha"), (6, "am1"), (6, "ab1"), (2, "1234_x"), (3, "abc 1234"), (4, "q")], "conversation_id long, subject string")
    labels = spark.createDataFrame([(3, "Sites"), (4, None)], "conversation_id long, label string")
    got = {r[0]: (r[1], r[2]) for r in project_of(s, labels, config).collect()}
    assert got == {1: ("B", "name"), 2: ("C", "code"), 3: ("S", "cluster"), 4: ("unknown", "unknown"), 5: ("A", "name"), 6: ("Xb", "name")}


def test_louvain():
    edges = [(a, b, 1.0) for g in (range(5), range(5, 10)) for a in g for b in g if a < b] + [(0, 5, 0.5)]
    got = louvain(edges)
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(5, 10)}) == 1 and got[0] != got[5]


def test_communities_against_louvain(spark):
    """One way at every size: no worse than the sequential form by more than a fiftieth of modularity."""
    from tessera.operators.graph import communities, modularity

    for seed in (1, 2):
        rng = random.Random(seed)
        ends = lambda g: (g * 12 + rng.randrange(12), (g if rng.random() < 0.85 else rng.randrange(8)) * 12 + rng.randrange(12))  # noqa: B023, E731
        edges = sorted({tuple(sorted(ends(g))) for g in range(8) for _ in range(60)})
        edges = [(a, b, 1.0 + rng.randrange(3)) for a, b in edges if a != b]
        df = spark.createDataFrame(edges, "a long, b long, weight double")
        plain = louvain(edges)
        want = modularity(df, spark.createDataFrame(list(plain.items()), "node long, community long"))
        found = communities(df)
        assert modularity(df, found) > 0.98 * want > 0.3
    assert communities(df.limit(0)).count() == 0


def test_mailbox(spark):
    raw = b"From: =?utf-8?q?J=C3=A1n?= <Jan@X.example>\r\nTo: a@x.example, b@x.example\r\nSubject: =?utf-8?q?=C4=8Das?=\r\nMessage-ID: <1>\r\nDate: Mon, 01 Jan 2024 10:00:00 +0100\r\nContent-Type: text/html\r\n\r\n<style>x</style><p>Hi&nbsp;you</p>"
    blank = b"Subject: b\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\nContent-Type: text/plain\r\n\r\n  \r\n--q\r\nContent-Type: text/html\r\n\r\n<b>html</b>\r\n--q\r\nContent-Type: text/plain\r\nContent-Disposition: attachment; filename=a.TXT\r\n\r\nno\r\n--q--"
    rows = {r.path: r for r in parse_messages(spark.createDataFrame([("1", raw), ("2", blank), ("3", None)], "path string, content binary")).collect()}
    m = rows["1"]
    assert (m["from_address"], m["from_name"], m["subject"], m["date"], m["body_text"], m["thread_id"]) == ("jan@x.example", "Ján", "čas", "2024-01-01T09:00:00Z", "Hi you", "<1>")
    assert (rows["2"].body_text, rows["2"].has_attachments, rows["2"].attachment_names, rows["2"].attachment_types) == ("", True, '["a.TXT"]', '["txt"]') and rows["3"].error and rows["3"].body_text is None
    assert parse_message(raw)["html"].startswith("<style>")
    assert header_text(None) == ""
    old = spark.createDataFrame([(1, "a")], "k long, v string")
    batch = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "k long, v string")
    assert [tuple(r) for r in new_rows(batch, old, "k", "v").collect()] == [(2, "c")]
    assert sorted(tuple(r) for r in update_columns(old.union(batch.limit(0)), spark.createDataFrame([(1, "z")], "k long, v string"), "k").collect()) == [(1, "z")]


def test_stream(spark, tmp_path):
    from tessera.streaming.ingest import ingest

    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, v string")
    df.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", df.schema, "k", "v")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "a"), (2, "b")]


def test_schemas(spark):
    from tessera.schemas import TABLES, migrate, schema

    assert all(schema(t).fields for t in TABLES)
    assert migrate(spark.range(3), "clusters").count() == 3


def test_bm25_equals_fts5(spark):
    import sqlite3

    from tessera.operators.bm25 import bm25

    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("alfa beta gama delta dom ulica".split()) for _ in range(rng.randrange(3, 20)))) for i in range(60)]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(t)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", [(i + 1, t) for i, t in docs])
    want = {i - 1: r for i, r in con.execute("SELECT rowid, rank FROM f WHERE f MATCH 'dom OR ulica'")}
    got = {r["id"]: r["rank"] for r in bm25(spark.createDataFrame(docs, "id long, t string"), "id", ["t"], ["dom", "ulica"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_density_clusters_against_brute_force(spark, monkeypatch):
    import numpy as np

    from tessera.operators import topics

    monkeypatch.setattr(topics, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(7)
    centers = rng.standard_normal((6, 64))
    v = np.vstack([c + 0.8 * rng.standard_normal((10, 64)) for c in centers] + [rng.standard_normal((20, 64)), np.zeros((1, 64))])
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    root = list(range(len(v)))
    for _ in range(len(v)):
        for i, j in zip(*np.nonzero(np.triu(unit @ unit.T, 1) >= 0.5), strict=True):
            root[i] = root[j] = min(root[i], root[j])
    want = {i: root[i] if root.count(root[i]) >= 5 else None for i in range(len(v))}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in topics.density_clusters(df, "id", "v", 0.5, 5).collect()}
    assert got == want and len(set(want.values())) > 3


def test_pairs_against_brute_force(spark, monkeypatch):
    """Pairs are dealt over as many tasks as they need, those of a person in most groups too."""
    from collections import Counter
    from itertools import combinations

    from tessera.operators import graph

    rng = random.Random(5)
    groups = {k: {0, *rng.sample(range(1, 40), rng.randrange(12))} for k in range(80)}
    rows = [(k, p) for k, g in groups.items() for p in g] * 2 + [(None, 1), (None, 2), (3, None)]
    df = spark.createDataFrame(rows, "k long, p long")
    monkeypatch.setattr(graph, "PAIRS_PER_TASK", 30)
    found = graph.pairs(df, "k", "p")
    want = Counter(x for g in groups.values() for x in combinations(sorted(g), 2))
    assert {(r.a, r.b): r.n for r in found.collect()} == want
    # the persons' rows are shuffled once, not the pairs
    sizes = [len(p) for p in found.rdd.glom().collect()]
    assert len(sizes) >= sum(want.values()) // 30 and max(sizes) <= 40
    edges = graph.edge_weights(df, df.where("k < 40"), spark.createDataFrame([(0,), (1,)], "person long"))
    second = Counter(x for k, g in groups.items() if k < 40 for x in combinations(sorted(g), 2))
    weights = {x: (3 * n + second[x]) * (0.2 if x == (0, 1) else 1.0) for x, n in want.items()}
    assert {(r.a, r.b): round(r.weight, 6) for r in edges.collect()} == {x: round(w, 6) for x, w in weights.items() if w >= 2}
    assert graph.pairs(df.limit(0), "k", "p").count() == 0


def counted(spark, df):
    """The frame, and an accumulator of how often its rows are made."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_degrees_make_edges_once(spark):
    from tessera.operators.graph import degrees

    edges, seen = counted(spark, spark.createDataFrame([(1, 2, 3.0), (2, 3, 2.0)], "a long, b long, weight double"))
    assert {r.node: (r.degree, r.weighted_degree, r.centrality) for r in degrees(edges).collect()} == {1: (1, 3.0, 0.5), 2: (2, 5.0, 1.0), 3: (1, 2.0, 0.5)}
    assert seen.value <= 4  # both ends


def test_community_summary_reads_once(spark):
    from tessera.operators.reports import community_summary

    edges, edges_seen = counted(spark, spark.createDataFrame([(1, 2, 3.0), (2, 3, 2.0)], "a long, b long, weight double"))
    mails, mails_seen = counted(spark, spark.createDataFrame([(1, 1, "Plan plan", "2024-01-01"), (1, 2, "Plan plan", "2024-01-01"), (2, 3, "Plan plan", "2024-02-01")], "id long, person long, subject string, day string"))
    people = spark.createDataFrame([(p, 1, p == 1, "x.example") for p in (1, 2, 3)], "person long, community long, internal boolean, domain string")
    (r,) = community_summary(edges, people, mails).collect()
    assert (r.size, r.n_int, list(r.top5), [tuple(w) for w in r.top_words], r.n_emails, r.first, r.last) == (3, 1, [2, 1, 3], [("plan", 4)], 2, "2024-01", "2024-02")
    assert edges_seen.value <= 4 and mails_seen.value <= 3


def test_communities_leave_labels_only(spark, monkeypatch, tmp_path):
    from tessera.operators import components
    from tessera.operators.graph import communities

    monkeypatch.setattr(components, "shared_path", lambda _, name: f"file://{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}-{random.random()}")
    edges = [(a, b, 1.0) for g in (range(5), range(5, 10)) for a in g for b in g if a < b] + [(0, 5, 0.5)]
    found = {r.node: r.community for r in communities(spark.createDataFrame(edges, "a long, b long, weight double")).collect()}
    assert len({found[i] for i in range(5)}) == 1 and len(set(found.values())) == 2
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["communities"]


def test_clean_body_looks_for_each_cut_once():
    from tessera.functions.text import QUOTE_CUTS, clean_body

    assert str(clean_body(F.col("x"))).count("regexp_instr") == len(QUOTE_CUTS)


def test_index_reads_texts_once(spark, tmp_path):
    from tessera.operators.bm25 import Index

    docs, seen = counted(spark, spark.createDataFrame([(1, "a b a"), (2, None), (3, "b. B?"), (1, "a c")], "id long, t string"))
    index = Index.build(docs, "id", ["t"], str(tmp_path))
    assert sorted(map(tuple, index.lengths.collect())) == [(1, 2), (1, 3), (2, 0), (3, 2)]
    assert sorted((r.term, r.id, r.n) for r in index.postings.collect()) == [("a", 1, 3), ("b", 1, 1), ("b", 3, 2), ("c", 1, 1)]
    assert seen.value == 4


def test_subject_runs_join_in_one_step(spark):
    from tessera.operators.conversations import subject_edges

    rows = [(i, f"2024-01-{i:02d}T00:00:00Z", "a@x.example", "Plan") for i in range(1, 9)] + [(9, "2024-12-01T00:00:00Z", "b@x.example", "Plan"), (10, "2024-12-02T00:00:00Z", "c@x.example", "Re: plan"), (11, None, "d@x.example", "Other")]
    mails = spark.createDataFrame(rows, "id long, date string, from_address string, subject string").withColumns({"to_addresses": F.lit(""), "cc_addresses": F.lit("")})
    assert sorted(map(tuple, subject_edges(mails).collect())) == [(1, i) for i in range(2, 9)] + [(9, 10)]
