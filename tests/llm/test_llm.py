"""The training-data operators against brute force, round trips and held-out data, and with odd inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import jaccard_join, mpeg_audio, packing, quality, secrets, url_filters, warc
from tessera.llm.mixing import mix, mixed

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, features string, repeats int, class string"
WORDS = "the of and house river stone cloud green walking summer quiet letter window morning between garden".split()


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text or ""), "clash", "clash", 9, "clash")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties."""
    rng = random.Random(3)
    rows = [doc(1, None), doc(2, ""), doc(3, " \n\t "), doc(None, "no id here at all"), doc(4, "one two"), doc(5, prose(rng, 40_000)), doc(6, prose(rng, 60), None, None)]
    rows += [doc(7, "twice " + prose(rng, 50))] * 2 + [doc(8, "x" * 5000), (9, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# ---- secrets


def test_guess_cost():
    assert secrets.guess_cost("password") < secrets.guess_cost("pa55word!") < secrets.guess_cost("kX9#vQ2$mZ7&")
    assert secrets.guess_cost("qwertyuiop") < 5 and secrets.guess_cost("1990-12-31") < 6 and secrets.guess_cost("abababababab") < 6
    assert secrets.guess_cost("") == 0 and secrets.guess_cost("z7" * 50_000) < 20


def test_scan():
    text = 'x Password="abcd1234" api_key: short token = aB3$xK9!pQz7 AKIA234567890ABCDEF password: changeme passphrase: "gT7#qLw9!rB2" é' + "0123456789abcdef" * 2
    got = secrets.scan(text)
    assert [k for k, *_ in got] == ["assign", "guess", "access", "assign", "guess", "hex"]
    for kind, a, b, _ in got:
        assert 0 <= a < b <= len(text) and kind in secrets.KINDS
    assert text[got[0][1] : got[0][2]] == 'Password="abcd1234' and text[got[4][1] : got[4][2]] == "gT7#qLw9!rB2"


def test_letter_secrets():
    for text in ("pwd: qkzvhxwmtrjpnbdf", "bearer qkzvhxwmtrjpnbdf", "x://user:QKZVHXWMTRJP@host", "passphrase: " + "qkzvhxwmtrjpnbdf" * 4, "pwd: qkzvhxwmtr47"):
        assert [k for k, *_ in secrets.scan(text)] == ["guess"], text
    assert secrets.guess_cost("banalitemoruda") < secrets.guess_cost("banalitemorudanovelatimo")


def test_wide_settings():
    for text in ("pwd:      gT7#qLw9!rB2", "access_key\t\t\t\t\t\t=      gT7#qLw9!rB2", "bearer         gT7qLw9rB2xZ4k"):
        assert [k for k, *_ in secrets.scan(text)] == ["guess"], text


def test_secrets_odd(odd, none):
    assert secrets.with_secrets(none).count() == 0
    assert secrets.with_secrets(odd).where("size(secrets) > 0").count() == 0
    assert secrets.redacted(odd).where("text IS NULL").count() == 2


def test_redact(spark):
    df = spark.createDataFrame([doc(1, "a password=hunter2hunter2 b"), doc(2, "clean")], DOC)
    assert {r.doc_id: (r.text, r.n_chars) for r in secrets.redacted(df).collect()} == {1: ("a [SECRET] b", 12), 2: ("clean", 5)}


# ---- quality


def brute_repeats(words):
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)})


def test_features():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "é\n", "# ", "word\t"]) for _ in range(rng.randrange(0, 60)))
        raw = text.encode()
        words = [w.decode() for w in raw.split()]
        lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        got = quality.features(raw)
        assert got[:6] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), sum(x in lines[:i] for i, x in enumerate(lines)), brute_repeats(words))


def test_quality(spark, odd, none):
    rng = random.Random(2)
    rows = [doc(i, prose(rng, 80)) for i in range(150)] + [doc(1000 + i, " ".join(w + "###" for w in prose(rng, 80).split())) for i in range(5)]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, DOC)).collect()}
    assert all(got[i] for i in range(150)) and not any(got[1000 + i] for i in range(5))
    assert quality.judged(none).count() == 0
    out = quality.judged(odd).collect()
    assert len(out) == odd.count() and not any(r.kept for r in out if r.text is None or len(r.text.split()) < 20)


# ---- WARC


def test_warc(spark):
    big = "é" * 600
    rows = [(1, "http://a/ b", big), (5, "http://b", big), (3, None, big), (2, "u", None), (4, "u", "small"), (6, "u", "small"), (None, "u", big), (5, "http://b", big)]
    got = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    want = Counter((i, "revisit" if i in (1, 3) else "response", 5 if i in (1, 3) else None, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows)
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got) == want
    assert warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_salvage():
    members = [warc.record(i, "u", bytes([65 + i]) * 3000, hashlib.sha1(bytes([65 + i]) * 3000).hexdigest()) for i in range(5)]
    data = bytearray(b"".join(members))
    start = len(members[0])
    data[start + 12 : start + 20] = b"\0" * 8
    got = list(warc.read_archive(bytes(data)))
    assert [g for g in got if isinstance(g, warc.Gap)][0][:2] == (start, start + len(members[1]))
    assert [g.headers["warc-record-id"] for g in got if isinstance(g, warc.Record)] == [f"<urn:page:{i}>" for i in (0, 2, 3, 4)]
    cut = list(warc.read_archive(b"".join(members)[:-5]))
    assert isinstance(cut[-1], warc.Gap) and len(cut) == 5
    plain = b"".join(warc._member(memoryview(m), 0)[0] for m in members[:3])
    broken = plain[:50] + b"?" + plain[51:]
    assert sum(isinstance(g, warc.Record) for g in warc.read_archive(plain)) == 3
    assert [type(g).__name__ for g in warc.read_archive(b"junk" + plain)] == ["Gap", "Record", "Record", "Record"] and list(warc.read_archive(b"")) == []
    assert sum(isinstance(g, warc.Record) for g in warc.read_archive(broken)) >= 2


def test_salvage_inside_members():
    import gzip

    sha = lambda b: hashlib.sha1(b).hexdigest()
    blocks = [random.Random(i).randbytes(90_000) for i in range(4)]
    plain = [gzip.decompress(warc.record(i, "u", b, sha(b))) for i, b in enumerate(blocks)]
    ids = lambda data: [int(g.headers["warc-record-id"][10:-1]) for g in warc.read_archive(data) if isinstance(g, warc.Record)]
    bad = plain[1][:5000] + b"?" + plain[1][5001:]
    data = gzip.compress(plain[0] + bad + plain[2]) + gzip.compress(plain[3])
    assert ids(data) == [0, 2, 3] and sum(isinstance(g, warc.Gap) for g in warc.read_archive(data)) == 1
    assert ids(gzip.compress(b"".join(plain))[:-1000]) == [0, 1, 2]
    long = "http://a/" + "x" * (2 << 20)
    assert [g.headers["warc-target-uri"] for g in warc.read_archive(warc.record(1, long, b"p", sha(b"p")))] == [long]


# ---- MPEG audio


def test_mpeg_round_trip():
    rng = random.Random(4)
    for n in (0, 1, 575, 576, 577, 5000):
        data = bytes(rng.choice([255, 251, 0, 65]) for _ in range(n))
        s = mpeg_audio.decode(mpeg_audio.encode(data))
        frames = max(1, -(-n // 576))
        assert s.payload == data + b"\xff" * (frames * 576 - n) and s.bad == 0 and not s.gaps and s.table["frames"] == frames == len(s.offsets) and s.duration * 16000 == 576 * frames and s.tags["payload_bytes"] == str(n)


def test_mpeg_resync():
    stream = bytearray(mpeg_audio.encode(b"a" * 576 * 6))
    whole = mpeg_audio.decode(bytes(stream))
    stream[whole.offsets[2]] = 0
    got = mpeg_audio.decode(bytes(stream))
    assert got.offsets == whole.offsets[:2] + whole.offsets[3:] and got.gaps == [(whole.offsets[2], whole.offsets[3])]
    stream = bytearray(mpeg_audio.encode(b"a" * 576 * 3))
    stream[whole.offsets[1] + 8] ^= 1
    assert mpeg_audio.decode(bytes(stream)).bad == 1
    assert mpeg_audio.decode(b"").offsets == [] and mpeg_audio.header(b"\xff\xfb\x90\x00").length == 417


def test_mpeg_odd(odd, none):
    got = mpeg_audio.index(mpeg_audio.store(odd)).select("audio.*").collect()
    assert len(got) == odd.count() and all(r.bad_frames == 0 and r.gap_bytes == 0 for r in got)
    assert mpeg_audio.index(mpeg_audio.store(none)).count() == 0


# ---- packing


def test_packing(odd, none):
    texts = Counter(r.text or "" for r in odd.collect())
    rows = packing.pack(odd.repartition(1)).collect()
    seen = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == seen.get(r.sequence_id, 0)
        seen[r.sequence_id] = r.offset + r.length
    assert max(seen.values()) <= 2048 and sum(n & n - 1 > 0 for n in seen.values()) <= 1
    sizes = Counter()
    for text, n in texts.items():
        sizes[len(packing.token_ids(text, *files()))] += n
    assert sum(seen.values()) == sum((k + 1) * n for k, n in sizes.items()) and packing.pack(none).count() == 0


def files():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_same_ids():
    full = packing._full(files()[0])
    for text in ("a <|endoftext|> b", "  x\n\n y z 1234 'll don't", "žluťoučký 漢字 🙂", "\x00\x1f", ""):
        assert packing.token_ids(text, *files()).tolist() == full.encode(text, add_special_tokens=False).ids


# ---- n-gram Jaccard join


def brute_roots(docs):
    return brute_components(docs, roots=True)


def brute_components(docs, roots=False):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if a and 100 * o >= 80 * (len(a) + len(sets[j]) - o):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    if roots:
        return [find(i) for i in range(len(docs))]
    return sets, [min((docs[k][0] for k in range(len(docs)) if find(k) == find(i) and docs[k][0] is not None), default=None) for i in range(len(docs))]


@pytest.mark.parametrize(("blocks", "hot", "part"), [(1000, 64, 1 << 20), (4, 64, 1 << 20), (4, 2, 300), (1000, 3, 1)])
def test_jaccard(spark, monkeypatch, blocks, hot, part):
    """Blocks, items that are hot in a part, and classes in several parts; rows that share an id, or have none."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", blocks)
    monkeypatch.setattr(jaccard_join, "HOT_IN_PART", hot)
    monkeypatch.setattr(jaccard_join, "PART_ITEMS", part)
    rng = random.Random(blocks)
    docs = []
    passage = prose(rng, 30).split()
    for g in range(6):
        base = prose(rng, rng.randrange(6, 80)).split()
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            docs.append(" ".join(w + (passage if rng.random() < 0.3 else [])))
    docs = list(enumerate([*docs, None, "", "a b", "A  b", "a b c"])) + [(7, docs[0]), (3, docs[-1]), (7, docs[5]), (None, docs[1]), (None, docs[1]), (3, docs[-1])]
    rng.shuffle(docs)
    sets, want = brute_components(docs)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, class string").repartition(5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect())
    assert got == Counter((i, len(s), i if c is None else c) for (i, _), s, c in zip(docs, sets, want, strict=True))
    kept = jaccard_join.one_of_each(df)
    rows = Counter((r.doc_id, r.text) for r in kept.collect())
    assert kept.columns == df.columns and not rows - Counter(docs)
    names = brute_roots(docs)
    held: dict = {}
    for k, (i, t) in enumerate(docs):
        if sets[k]:
            held.setdefault(names[k], []).append((i, t))
    assert sum(n for (i, t), n in rows.items() if (t or "").split()) == len(held)
    for group in held.values():
        left = [r for r in rows.elements() if r in group]
        assert len(left) == 1 and left[0][0] == min((i for i, _ in group if i is not None), default=None)


def test_hot_components(spark, monkeypatch):
    edges = spark.range(1, 3000).selectExpr("7000L AS a", "id AS b").unionAll(spark.range(5000, 5040).selectExpr("id AS a", "id + 1 AS b"))
    monkeypatch.setattr(jaccard_join, "HOT", 1 << 40)
    assert {r[0] for r in jaccard_join._salted(edges).where("b = 7000").select("salt").distinct().collect()} == set(range(jaccard_join.SALTS))
    assert {r["node"]: r["component"] for r in jaccard_join.components(edges).collect()} == {i: 1 for i in [*range(1, 3000), 7000]} | {i: 5000 for i in range(5000, 5041)}
    assert jaccard_join.components(edges.limit(0)).count() == 0


def test_tree():
    rng = random.Random(9)
    for _ in range(100):
        sets = [np.array(sorted(rng.sample(range(40), rng.randrange(1, 20))), np.uint64) for _ in range(25)]
        sizes = [len(s) + rng.randrange(0, 3) for s in sets]
        tree = jaccard_join.PrefixTree(60)
        for s, n in zip(sets, sizes, strict=True):
            tree.add(s, n)
        root = list(range(25))
        for _ in range(25):
            for i in range(25):
                for j in range(i):
                    o = len(np.intersect1d(sets[i], sets[j]))
                    if 100 * o >= 60 * (sizes[i] + sizes[j] - o):
                        root[i] = root[j] = min(root[i], root[j])
        assert [tree.find(i) for i in range(25)] == root


def test_jaccard_odd(odd, none):
    assert jaccard_join.jaccard_components(none).count() == 0
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd).collect()}
    assert (1, 0, 1) in got and (3, 0, 3) in got and (7, 47, 7) in got and (None, 1, None) in got


# ---- mixing


def water_fill(sizes, weights, share=1.5, most=2):
    target, free, left = {}, dict(weights), share * sum(sizes.values())
    while free:
        level = left / sum(free.values())
        over = [s for s in free if free[s] * level > most * sizes[s]]
        if not over:
            return target | {s: w * level for s, w in free.items()}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            del free[s]
    return target


def test_mixing(spark, odd, none):
    rng = random.Random(5)
    rows = [doc(i, prose(rng, rng.randrange(0, 200)), source=rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(400)]
    df = spark.createDataFrame(rows, DOC)
    got = mix(df).collect()
    sizes, taken, names = Counter(), Counter(), {r[0]: r[3] for r in rows}
    for r in got:
        sizes[names[r.doc_id]] += r.size
        taken[names[r.doc_id]] += r.taken
        assert r.size == len(rows[r.doc_id][1].split()) and r.taken <= 2 * r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    for r in got:
        assert math.isclose(r.target, want[names[r.doc_id]], rel_tol=1e-9)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, mix(df).collect())) == sorted(map(tuple, got))
    words = Counter()
    for r in mixed(df).collect():
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - want[s]) <= 200 for s in sizes) and mixed(df).columns == df.columns
    assert mix(none).count() == 0 and mixed(none).count() == 0 and mix(odd).count() == odd.count()


# ---- URL filters


def test_urls(spark):
    urls = ["http://a.net/x", "http://NET/", "http://xnet/", "http://example.net/en/a", "http://b.example.net/de/", "https://example.com/de/x?q", "https://example.com/d", "ftp://x.org/fr/#a", "x.org/fr/", None, "", "://net/", "http://net", "http://a.net/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r.rule, r.verdict) for r in url_filters.judge(df, url_filters.rules_frame(spark)).orderBy("page_id").collect()]
    no = (None, "allow")
    assert got == [("net/", "block"), ("net/", "block"), no, ("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), no, ("org/fr/", "allow"), no, no, no, ("net/", "block"), no, ("net/", "block")]
    assert url_filters.judge(df, url_filters.rules_frame(spark, ())).where("rule IS NULL").count() == len(urls)
    assert url_filters.judge(df.limit(0), url_filters.rules_frame(spark)).count() == 0


# ---- pipeline


def test_pipeline(spark, odd):
    import corpus_pipeline

    rng = random.Random(8)
    clean = [prose(rng, 120) for _ in range(30)]
    rows = [doc(i, t)[:5] for i, t in enumerate(clean)] + [doc(100 + i, t + " tail")[:5] for i, t in enumerate(clean[:5])] + [doc(200, "short")[:5], doc(201, prose(rng, 60) + " password=abcd1234efgh")[:5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {200} and kept.columns == docs.columns
    one = stages["n-gram Jaccard join"](spark, kept, "")
    assert {r.doc_id for r in one.collect()} == {*range(30), 201}
    clear = stages["secret scans"](spark, one, "")
    assert clear.where("text LIKE '%abcd1234%'").count() == 0 and clear.count() == one.count()
    assert stages["mixing sources to target weights"](spark, clear, "").columns == docs.columns
    assert {r.doc_id for r in stages["packing"](spark, clear, "").collect()} == {r.doc_id for r in clear.collect()}


def test_oracles(spark):
    """Operators that SQL can express, over whole tables."""
    import duckdb

    from tessera.llm import registry

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, "/root/testdata/sf0.001")
        assert sorted(df.columns) == sorted(con.sql(sql).columns)
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, con.sql(sql).select(*df.columns).fetchall())), name


# ---- clashing names, long urls, packing's promises


def test_clashing_names(spark):
    kind = "page_id long, url string, won string, k_host string, short string, rule_host string, verdict string, full string"
    long = "http://" + "a." * 3000 + "example.net/en/" + "x/" * 100_000
    df = spark.createDataFrame([(1, "http://net/x", *"abcdef"), (2, long, *"abcdef"), (3, None, *[None] * 6)], kind)
    out = url_filters.judge(df, url_filters.rules_frame(spark))
    assert out.columns == ["page_id", "url", "won", "k_host", "short", "rule_host", "full", "host", "path", "rule", "verdict"]
    assert {r.page_id: (r.rule, r.verdict, r.won) for r in out.collect()} == {1: ("net/", "block", "a"), 2: ("example.net/en/", "allow", "a"), 3: (None, "allow", None)}
    pages = spark.createDataFrame([(1, "u", "h" * 1200, "a", "b"), (2, "v", "h" * 1200, "a", "b"), (None, "w", "h" * 3_000_000, None, None)], "page_id long, url string, html string, digest string, key string")
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert Counter((r.page_id, r.record_type, r.payload_bytes) for r in got) == Counter([(1, "revisit", 1200), (2, "response", 1200), (None, "response", 3_000_000)])


def test_rules_beyond_a_broadcast(spark, monkeypatch):
    urls = spark.createDataFrame([(i, f"http://h{i % 7}.net/p{i % 5}/x") for i in range(200)], "page_id long, url string")
    want = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(urls, url_filters.rules_frame(spark)).collect()}
    monkeypatch.setattr(url_filters, "BROADCAST_BYTES", 0)
    assert {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(urls, url_filters.rules_frame(spark)).collect()} == want


def test_spread_moves_the_verdict(spark):
    """The same document is an outlier among even ones and none among varied ones."""
    rng = random.Random(4)
    even = [doc(i, " ".join(f"word{rng.randrange(10)}" for _ in range(60)), "en", "even") for i in range(150)]
    varied = [doc(1000 + i, " ".join("x" * rng.randrange(3, 6 + i % 7) for _ in range(60)), "en", "varied") for i in range(150)]
    odd_one = " ".join(f"longword{k:02d}" for k in range(60))
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame([*even, *varied, doc(5001, odd_one, "en", "even"), doc(5002, odd_one, "en", "varied")], DOC)).collect()}
    assert not got[5001] and got[5002]


def test_packing_covers_every_id_once(spark, odd):
    rows = [tuple(r) for r in odd.collect()]
    named = [(k, r[1]) for k, r in enumerate(rows)]
    df = spark.createDataFrame(named, "doc_id long, text string").repartition(3)
    got = packing.pack(df).collect()
    ids = {i: np.append(packing.token_ids(t or "", *files()), packing.END_ID).astype("<u4") for i, t in named}
    at, groups = Counter(), {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
        assert r.tier in packing.TIERS and r.offset + r.length <= r.tier
        groups.setdefault(r.step_group, {})[r.sequence_id] = r.tier
    assert at == Counter({i: len(x) for i, x in ids.items()})


def test_packing_balances_steps(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, prose(rng, rng.choice([20, 60, 150, 400, 900]))) for i in range(600)], "doc_id long, text string").repartition(1)
    steps: dict = {}
    for r in packing.pack(df).collect():
        steps.setdefault(r.step_group, {})[r.sequence_id] = r.tier
    full = [Counter(s.values()) for s in steps.values()]
    for tier in packing.TIERS:
        n = [c[tier] for c in full]
        assert max(n) - min(n) <= 2, tier


def test_salvage_of_every_cut_and_flip():
    """Five records in one member, cut or with a bit flipped anywhere: those that lie wholly before the damage come back."""
    import gzip

    sha = lambda b: hashlib.sha1(b).hexdigest()
    blocks = [random.Random(i).randbytes(400) for i in range(5)]
    plain = [gzip.decompress(warc.record(i, "u", b, sha(b))) for i, b in enumerate(blocks)]
    data = gzip.compress(b"".join(plain), mtime=0)
    number = lambda g: int(g.headers["warc-record-id"][10:-1])
    best = 0
    for cut in range(20, len(data), 37):
        for broken in (data[:cut], data[:cut] + bytes([data[cut] ^ 16]) + data[cut + 1 :]):
            got = list(warc.read_archive(broken + warc.record(9, "u", b"p", sha(b"p"))))
            found = [g for g in got if isinstance(g, warc.Record)]
            sure = {number(g) for g in found if g.payload in blocks and blocks.index(g.payload) == number(g)}
            assert all(g.payload in blocks or g.payload == b"p" for g in found) and number(found[-1]) == 9
            assert all(not g.checked or g.payload == (blocks[number(g)] if number(g) < 9 else b"p") for g in found)
            whole = warc._partial(memoryview(data[:cut]), 0)
            assert sure >= {i for i in range(5) if len(b"".join(plain[: i + 1])) < len(whole)}
            assert any(isinstance(g, warc.Gap) for g in got)
            best = max(best, len(found))
    assert best >= 4
