"""Every registered query of the library's own operators against DuckDB."""

import math

import duckdb
import pytest

from tessera.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return repr(round(v, 4) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    want = duck.sql(ORACLE[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"stitch_conversations"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_stitched_against_brute_force(spark):
    import re
    from datetime import datetime

    from tessera.plans.queries import stand_in_mails, stitch_conversations

    mails = sorted(stand_in_mails(spark, SF).collect(), key=lambda r: (r["date"], r["id"]))
    root = {r["id"]: r["id"] for r in mails}
    of = {r["message_id"]: r["id"] for r in mails}

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    before = {}
    for r in mails:
        if r["in_reply_to"] in of:
            root[find(r["id"])] = find(of[r["in_reply_to"]])
        subject = re.sub(r"^re: ", "", r["subject"].lower())
        people = {a for a in [r["from_address"], *r["to_addresses"].split(",")] if a}
        ts = datetime.fromisoformat(r["date"][:19])
        if subject in before:
            i, earlier, others = before[subject]
            if (ts - earlier).days <= 60 or people & others:
                root[find(r["id"])] = find(i)
        before[subject] = (r["id"], ts, people)
    number = {}
    for r in mails:
        number.setdefault(find(r["id"]), len(number) + 1)
    assert {r["id"]: r["conversation_id"] for r in stitch_conversations(spark, SF).collect()} == {i: number[find(i)] for i in root}
