"""Flows end to end with the stand-in model: sync, bodies, embeddings, clusters, labels, answers, snapshots, threads."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.models import HashProvider, apply
from tessera.operators import flows, segments
from tessera.sources import mailbox


def message(mid, subject="S", body="text of it", sender="a@x.example", date="Mon, 01 Jan 2024 10:00:00 +0000"):
    head = f"From: {sender}\r\nTo: b@x.example\r\nSubject: {subject}\r\nDate: {date}\r\n" + (f"Message-ID: {mid}\r\n" if mid else "")
    return (head + f"\r\n{body}\r\n").encode()


MESSAGES = "folder string, uid long, content binary"


def test_sync_twice(spark):
    rows = [("in", 1, message("<1>")), ("in", 2, message("<2>")), ("in", 3, message("<1>")), ("in", 4, message(None)), ("out", 7, message("<2>")), ("out", 8, None)]
    emails, state = spark.createDataFrame([], "message_id string"), spark.createDataFrame([("in", 2), ("old", 9)], "folder string, last_uid long")
    got = flows.sync(spark.createDataFrame(rows, MESSAGES), emails, state)
    assert sorted((r.folder, r.imap_uid, r.message_id) for r in got["emails"].collect()) == [("in", 1, "<1>"), ("in", 2, "<2>"), ("in", 4, "<no-id-uid-4@in>")]
    assert sorted(map(tuple, got["stats"].collect())) == [("in", 3, 1, 0), ("out", 0, 1, 1)]
    assert sorted(map(tuple, got["state"].collect())) == [("in", 4), ("old", 9), ("out", 7)]
    assert [(r.folder, r.imap_uid) for r in got["errors"].collect()] == [("out", 8)]
    again = flows.sync(spark.createDataFrame(rows, MESSAGES), got["emails"], got["state"])
    assert again["emails"].count() == 0 and sorted(r.skipped for r in again["stats"].collect()) == [1, 4]


def test_what_to_fetch(spark):
    server = spark.createDataFrame([("in", u, f"2024-01-0{u}") for u in range(1, 7)] + [("new", u, f"2024-01-0{u}") for u in range(1, 5)], "folder string, uid long, day string")
    state = spark.createDataFrame([("in", 4)], "folder string, last_uid long")
    pick = lambda **k: sorted(map(tuple, mailbox.uids_to_fetch(server, state, **k).collect()))
    assert pick() == [("in", 5), ("in", 6)] + [("new", u) for u in range(1, 5)]
    assert pick(since="2024-01-03") == [("in", 5), ("in", 6), ("new", 3), ("new", 4)]
    assert pick(known=server.where("uid % 2 = 0").select("folder", "uid"), most=2) == [("in", 1), ("in", 3), ("new", 1), ("new", 3)]
    lines = spark.createDataFrame([('(\\HasNoChildren) "/" "In Box"',), ('(\\Noselect) "/" "Root"',), ('() "/" Plain',)], "line string")
    assert sorted(r.folder for r in mailbox.folders(lines).collect()) == ["In Box", "Plain"]


def test_bodies_and_embeddings(spark):
    pending = spark.createDataFrame([(1, "in", 1), (2, "in", 2), (3, "in", 3), (4, "in", 4)], "id long, folder string, imap_uid long")
    got = flows.fetch_bodies(pending, spark.createDataFrame([("in", 1, message("<1>", body="x" * 2000)), ("in", 2, message("<2>", body="  ")), ("in", 3, None)], MESSAGES))
    assert {r.id: (len(r.body_text), len(r.body_snippet)) for r in got["updates"].collect()} == {1: (1000, 150), 2: (0, 0)}
    assert [tuple(r) for r in got["stats"].collect()] == [("in", 1, 1, 2)] and got["errors"].count() == 2
    mails = spark.createDataFrame([(1, "a b", "n", "c"), (2, None, None, None)], "id long, subject string, from_name string, body_text string")
    out = flows.embed_pending(mails, HashProvider(16), 16)
    assert [(r.id, len(r.embedding)) for r in out["updates"].collect()] == [(1, 16)] and [tuple(r) for r in out["errors"].collect()] == [(2, "no vector")]
    assert [r.error for r in flows.embed_pending(mails.where("id = 1"), HashProvider(16), 8)["errors"].collect()] == ["dimension 16"]


class Failing(HashProvider):
    def generate(self, prompts):
        if len(prompts) > 1 or "bad" in prompts[0]:
            raise ValueError("no")
        return [p.upper() for p in prompts]


def test_calls_that_fail(spark):
    df = spark.createDataFrame([(1, "one"), (2, "bad"), (3, None)], "id long, t string").coalesce(1)
    assert sorted((r.id, r.result, bool(r.error)) for r in apply(df, "id", "t", Failing()).collect()) == [(1, "ONE", False), (2, None, True), (3, "", False)]


class Naming(HashProvider):
    def generate(self, prompts):
        return [json.dumps({"nazov": "Found " + p.splitlines()[-1], "popis": "d"}) if "good" in p else "\n plain line\nmore" for p in prompts]


def test_cluster_and_label(spark):
    clusters = spark.createDataFrame([], "id long, label string, description string, size long, created_at string, updated_at string")
    members = spark.createDataFrame([(1, 5, 1.0, "manual", "t"), (2, 6, 1.0, "hdbscan", "t")], "email_id long, cluster_id long, confidence double, source string, created_at string")
    found = spark.createDataFrame([(1, 30, 0.5), (2, 30, 0.9), (3, 40, 0.7), (4, None, 0.0)], "email_id long, cluster long, confidence double")
    c, m = mailbox.replace_clusters(clusters, members, found, "hdbscan", "now")
    assert sorted((r.id, r.label, r.size) for r in c.collect()) == [(1, "cluster_30", 2), (2, "cluster_40", 1)]
    assert sorted((r.email_id, r.cluster_id or 0, r.source) for r in m.collect()) == [(1, 1, "hdbscan"), (1, 5, "manual"), (2, 1, "hdbscan"), (3, 2, "hdbscan"), (4, 0, "hdbscan")]
    mails = spark.createDataFrame([(1, "good one", "x"), (2, "good two", "y"), (3, "other", "z")], "id long, subject string, body_snippet string")
    got = flows.label_clusters(c.unionByName(spark.createDataFrame([(9, "e", None, 1, "", "")], c.schema)), m.where("source = 'hdbscan'"), mails, Naming())
    assert {r.id: (r.label, r.description) for r in got["updates"].collect()} == {1: ("Found    x", "d"), 2: ("plain line", "")} and [r.id for r in got["errors"].collect()] == [9]
    rows = mailbox.upsert(c.select("id", "label"), spark.createDataFrame([(2, "two"), (3, "three")], "id long, label string"), "id")
    assert sorted(map(tuple, rows.collect())) == [(1, "cluster_30"), (2, "two"), (3, "three")]
    topics = spark.createDataFrame([(1, 1, 0.9, 1, 0), (1, 7, 0.8, 2, 0)], "email_id long, cluster_id long, similarity double, rank int, low_confidence int")
    assert {r.cluster_id: r.label for r in flows.topics_of(topics, c).collect()} == {1: "cluster_30", 7: "cluster_7"}


@pytest.fixture(scope="module")
def mails(spark):
    rows = [(i, f"t{i // 4}" if i < 20 else None, f"subject {i // 4}", f"p{i % 3}@x.example" if i != 5 else "robot", f"2024-01-{i + 1:02d}T10:00:00Z", f"body {i}\n> quoted" if i != 6 else "", "s", "b@x.example") for i in range(24)]
    return spark.createDataFrame(rows, "id long, thread_id string, subject string, from_address string, date string, body_text string, body_snippet string, to_addresses string").cache()


def test_answers_and_ask(spark, mails, tmp_path):
    direct = spark.createDataFrame([(0, 0.7), (8, 0.9), (22, 0.8)], "id long, score double")
    more = spark.createDataFrame([(1, 0.5), (12, 0.6)], "id long, score double")
    clusters = spark.createDataFrame([(1, "one")], "id long, label string")
    members = spark.createDataFrame([(8, 1, "hdbscan"), (0, 1, "manual")], "email_id long, cluster_id long, source string")
    rows = flows.answers(mails, direct, members, clusters, more).collect()
    assert [r.id for r in rows] == [8, 9, 10, 11, 0, 1, 2, 3, 12, 22]
    by = {r.id: r for r in rows}
    assert (by[8].cluster_label, by[0].cluster_label, by[9].expanded, by[9].score, by[12].person_expanded, by[1].person_expanded, by[8].thread_score) == ("one", "noise", True, None, True, False, 0.9)
    found = spark.createDataFrame(rows)
    people = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("z", 9)], "person string, email_count long")
    membership = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "person string, community long")
    communities = spark.createDataFrame([(1, 3, "2024-01"), (2, 8, "2023-12")], "community long, size long, last string")
    one = flows.ask(found, people, membership, communities, "2024-01-20").collect()
    assert [tuple(r) for r in one] == [(2, 6, 10, 3, ["b", "c"], True)]
    assert flows.ask(found, people.limit(0), membership, communities, "2024-01-20").count() == 0
    asked = spark.createDataFrame([("q", 2, 6), ("r", 1, 5)], "query string, community long, hit_score long")
    emails = mails.withColumn("embedding", F.when(F.col("id") < 3, F.array(F.lit(1.0))))
    top = spark.createDataFrame([(1, "x", 4), (2, None, 9)], "id long, label string, size long")
    s = flows.snapshot(emails, top, communities, asked, "now")
    mailbox.write_json(s, f"{tmp_path}/snapshot")
    doc = json.loads(next(tmp_path.glob("snapshot/*.json")).read_text())
    assert doc["db_stats"] == {"total_emails": 24, "with_body_text": 23, "with_embedding": 3} and [c["id"] for c in doc["top_clusters"]] == [2, 1] and doc["largest_size"] == 8 and [c["community"] for c in doc["communities"]] == [2, 1]
    back = mailbox.read_json(spark, f"{tmp_path}/snapshot", "reference_queries array<struct<query:string,community:long,hit_score:long>>")
    later = flows.snapshot(emails, top, communities, asked.withColumn("community", F.lit(2).cast("long")), "later")
    assert sorted((r.query, r.moved) for r in flows.changes(back, later).collect()) == [("q", False), ("r", True)]


def test_threads(spark, mails):
    t = {r.thread_id: r for r in flows.threads(mails, None, 3).collect()}
    assert sorted(t) == ["t0", "t1", "t2", "t3", "t4"] and t["t1"].n == 3 and "robot" not in t["t1"].participants
    assert (t["t0"].date_from, t["t0"].date_to, t["t0"].subject, t["t0"].participants) == ("2024-01-01", "2024-01-04", "subject 0", ["p0@x.example", "p1@x.example", "p2@x.example"])
    assert [r.thread_id for r in flows.largest_thread(mails, F.col("subject").contains("3"), 3, 4).collect()] == ["t3"]
    picks = [sorted(r.thread_id for r in flows.random_threads(mails, F.col("subject").contains("3"), 2, 4, s).collect()) for s in (1, 1, 2, 3, 4, 5)]
    assert picks[0] == picks[1] and len({*map(tuple, picks)}) > 1 and all(len(p) == 2 and "t3" not in p and "t1" not in p for p in picks)
    doc = flows.thread_documents(mails, spark.createDataFrame([("t0",)], "thread_id string"), 2).collect()
    assert doc[0].thread == "[2024-01-01T10:00] p0@x.example → b@x.example\nbody 0\n\n---\n\n[2024-01-04T10:00] p0@x.example → b@x.example\nbody 3"
    assert [tuple(r) for r in flows.large_folders(mails.withColumn("folder", F.col("thread_id")), 4).where("folder = 't1'").collect()] == [("t1", 4, 0)]
    assert [r.id for r in segments.runs(mails.where("id < 8"), "thread_id", [F.col("id")], "subject").orderBy("id").collect()] == [0, 4]
    assert [tuple(r) for r in flows.window_counts(mails.withColumn("conversation_id", F.col("thread_id")), 10).collect()] == [(7, 2)]


def test_models_side_by_side(spark):
    prompts = spark.createDataFrame([(1, "abcd efgh"), (2, "bad")], "key long, prompt string")
    rows, cost = flows.compare_models(prompts, {"a": HashProvider(), "b": Failing()}, {"a": (1.0, 2.0)})
    assert sorted((r.model, r.key, r.error is None) for r in rows.collect()) == [("a", 1, True), ("a", 2, True), ("b", 1, True), ("b", 2, False)]
    assert {r.model: (r.calls, r.tokens_in, r.cost > 0) for r in cost.collect()} == {"a": (2, 4, True), "b": (2, 4, False)}


def test_blobs(spark):
    df = spark.createDataFrame([(1, [1.5, -2.0]), (2, []), (3, None)], "id long, v array<double>")
    back = df.select("id", mailbox.from_blob(mailbox.to_blob(F.col("v"))).alias("v"), F.length(mailbox.to_blob(F.col("v"))).alias("n")).orderBy("id").collect()
    assert [(r.v, r.n) for r in back] == [([1.5, -2.0], 8), ([], 0), (None, None)]


class Episodes(HashProvider):
    def generate(self, prompts):
        return ["2024-02-01 - 2024-02-10 | start\n2024-02-11 - 2024-02-25 | the rest\n2025-01-01: nothing" if p.startswith("List") else f"SUMMARY: {p.count('---') + 1} mails\nOPEN: x" for p in prompts]


def test_active_threads(spark):
    from tessera.config import EngineConfig
    from tessera.operators.conversations import active_threads

    rows = [(i, 1, f"2024-02-{i + 1:02d}T10:00:00Z", f"a{i % 2}@firm.example", "c@other.example", "", "Re: Alpha plan", f"body {i}") for i in range(24)]
    rows += [(100 + i, 2, f"2024-02-{10 + i:02d}T10:00:00Z", "a@firm.example", "b@firm.example", None, "Beta", "text" if i < 2 else " ") for i in range(3)]
    rows += [(200, 3, "2024-02-20T10:00:00Z", "x@y.example", "", "", "single", "t"), (300, 4, "2024-02-20T10:00:00Z", "noreply@y.example", "", "", "bulk", "t"), (301, 4, "2024-02-21T10:00:00Z", "noreply@y.example", "", "", "bulk", "t")]
    mails = spark.createDataFrame(rows, "id long, conversation_id long, date string, from_address string, to_addresses string, cc_addresses string, subject string, body_text string")
    config = EngineConfig(firms={"firm.example": "Firm"}, name_rules=(("alpha", "A"),), cluster_rules=(("sites", "S"),))
    labels = spark.createDataFrame([(1, None), (2, "sites x")], "conversation_id long, label string")
    got = {r.conversation_id: r.asDict() for r in active_threads(mails, labels, Episodes(), config, "now").collect()}
    assert sorted(got) == [1, 2]
    one, two = got[1], got[2]
    assert (one["subject"], one["last_activity"], one["n_window"], one["n_streak"], one["is_segmented"]) == ("Alpha plan", "2024-02-24", 24, 24, 1)
    assert (one["episode_from"], one["episode_to"], one["summary"], one["open_points"]) == ("2024-02-11", "2024-02-25", "14 mails", "x")
    assert (one["participants"], one["firms"], one["project"], one["project_source"]) == ("Firm: a0, a1 | ext:other.example: c", "Firm|ext:other.example", "A", "name")
    assert (two["episode_from"], two["episode_to"], two["summary"], two["is_segmented"], two["project"], two["project_source"]) == ("2024-02-10", "2024-02-11", "2 mails", 0, "S", "cluster")


def test_index_equals_scan(spark, tmp_path):
    from tessera.operators.bm25 import Index, bm25

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    index = Index.build(docs, "doc_id", ["text"], str(tmp_path))
    round_ = lambda df: {r.id: round(r.rank, 9) for r in df.collect()}
    want = round_(bm25(docs, "doc_id", ["text"], ["the", "thing", "of"]))
    assert round_(index.ranks(["the", "thing", "of"])) == want and index.hit_count(["the", "thing", "of"]).first()[0] == len(want)
    assert "PartitionFilters: [" in index.hits(["the"])._jdf.queryExecution().toString() and index.ranks(["nosuchterm"]).count() == 0
