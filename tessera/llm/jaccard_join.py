"""N-gram Jaccard join: a prefix-tree join over globally ordered shingle sets, and the components of its links.

1. Classes: each document's set of hashed shingles; equal sets are one class.
2. Shared items: shingles dealt out by hash; each bucket counts in how many classes a shingle occurs and answers with
   those of two or more. Shingles that many classes of a part have are counted there, so a bucket gets one number a part
   for them; their classes go on directly. A class of whose shingles too few are shared can't link and ends here.
3. Rare shingles come first in the prefix filter: two linked sets share an item among the first size - ceil(t * size) + 1.
   The least class with an item leads it, and classes with a common leader form a group, so every link lies in a group.
4. A group's sets, frequent items first, are stored in a prefix tree that a query descends with the overlap so far.
   Subtrees whose sizes or remaining lengths can't reach the threshold are pruned, and so are those that are already
   known to be connected with the query, since only components are asked for. Large groups are cut into blocks that
   all hold the leader; later, pairs of blocks are joined where a group isn't connected yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tidy, documents, drop, fresh, prepare, quoted, table, text_bytes

#: Words of a shingle, and the threshold in percent.
WORDS, PERCENT = 5, 80
#: Shingles of a map task that are dealt out at once, and bytes of text for each bucket.
PART_ITEMS, BUCKET_TEXT = 1 << 20, 16 << 20
#: Sets, and bytes of sets, from which a group is cut into blocks.
BLOCK_SETS, BLOCK_BYTES = 500, 8 << 20
#: Classes of a part from which a shingle is counted within the part; bytes of sets that a task of the join gets.
HOT_IN_PART, TASK_BYTES = 64, 16 << 20
_M, _MIX, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
KNOWN_WORDS = 200_000


class _Known(dict):
    """Hashes of words as they are asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_known = _Known()


def _forget() -> None:
    _known.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _HALF)) * _MIX
    return (x ^ (x >> _HALF)) * _MIX


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; of fewer words, one for the whole sequence; of none, empty."""
    tokens = text.lower().split()
    if len(_known) > KNOWN_WORDS:
        _known.clear()
    one = np.fromiter(map(_known.__getitem__, tokens), np.uint64, len(tokens))
    n = len(one)
    if not n:
        return one
    width = min(n, words)
    whole = one[: n - width + 1].copy()
    for k in range(1, width):
        whole = whole * _M + one[k : k + len(whole)]
    return np.unique(_mix(whole + np.uint64(width)))


def _class_of(items: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(items.tobytes(), seed=len(items)) >> 1


CLASS = "struct<class:long,size:long>"


def _classes(texts: pa.Array) -> pa.Array:
    names, sizes = [], []
    for t in texts.cast(pa.binary()).to_pylist():
        items = shingles(t or b"")
        names.append(_class_of(items) if len(items) else None)
        sizes.append(len(items))
    return pa.StructArray.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64())], ["class", "size"])


#: Rows between parts and buckets. Kinds: 0 classes of a part with their items in a bucket, or the shared ones of them;
#: 1 hot items of a part's classes, which go from the part straight to ``_gather``; 2 counts of a part's hot items, or
#: in how many classes they are; 3 classes at home in a bucket, or those that another part stands for.
PACKED = "kind int, bucket long, part long, classes binary, sizes binary, counts binary, items binary, spread binary"
_PACKED = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("part", pa.int64()), *[(c, pa.binary()) for c in ("classes", "sizes", "counts", "items", "spread")]])


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    raw = lambda x: x.tobytes() if isinstance(x, np.ndarray) else x
    return pa.RecordBatch.from_arrays([pa.array(map(raw, c), t.type) for c, t in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)


def _places(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The indices of each bucket that occurs, ascending."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in range(buckets):
        if ends[k] < ends[k + 1]:
            yield k, order[ends[k] : ends[k + 1]]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> _HALF) * np.uint64(buckets) >> _HALF).astype(np.int64)


def _deal(buckets: int):
    """Rows (PACKED) of a map task's parts, which are packed at PART_ITEMS items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        held: dict[int, np.ndarray] = {}
        total = 0

        def rows() -> Iterator[pa.RecordBatch]:
            names, sets = np.fromiter(held, np.int64, len(held)), list(held.values())
            sizes = np.fromiter(map(len, sets), np.int32, len(sets))
            items = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), sizes)
            out = [(3, k, part, names[at], None, None, None, None) for k, at in _places(_bucket(_mix(names.view(np.uint64)), buckets), buckets)]
            order = np.sort(items)
            ahead = order[HOT_IN_PART - 1 :]
            hot, times = np.unique(ahead[ahead == order[: len(ahead)]], return_counts=True)
            if len(hot):
                out += [(2, k, part, None, None, (times[at] + HOT_IN_PART - 1).astype(np.int64), hot[at], None) for k, at in _places(_bucket(hot, buckets), buckets)]
                is_hot = hot[np.minimum(np.searchsorted(hot, items), len(hot) - 1)] == items
                who, count = np.unique(owner[is_hot], return_counts=True)
                out.append((1, -1 - part, part, names[who], sizes[who], count.astype(np.int32), items[is_hot], None))
                items, owner = items[~is_hot], owner[~is_hot]
            for k, at in _places(_bucket(items, buckets), buckets):
                who, count = np.unique(owner[at], return_counts=True)
                out.append((0, k, part, names[who], sizes[who], count.astype(np.int32), items[at], None))
            yield _packed(out)

        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                items = shingles(t or b"")
                if len(items) and (name := _class_of(items)) not in held:
                    held[name] = items
                    total += len(items)
                if total >= PART_ITEMS:
                    yield from rows()
                    part, total = part + 1, 0
                    held.clear()
        if held:
            yield from rows()

    return run


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[dict]]:
    """Lists of consecutive rows with equal keys."""
    held, key = [], None
    for b in batches:
        for row in b.to_pylist():
            k = tuple(row[x] for x in keys)
            if k != key and held:
                yield held
                held = []
            key = k
            held.append(row)
    if held:
        yield held


def _ints(rows: list[dict], column: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(r[column], kind) for r in rows]


def _joined_up(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.empty(0, kind)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket: of every class once, in its first part, the items that occur in two classes or more, with their
    counts; the counts of hot items; and the classes whose first part is another."""
    for rows in _groups(batches, "bucket"):
        if rows[0]["kind"] == 1:
            yield from (_packed([tuple(r[c] for c in _PACKED.names)]) for r in rows)
            continue
        rows.sort(key=lambda r: r["part"])
        dealt, hot, home = ([r for r in rows if r["kind"] == k] for k in (0, 2, 3))
        out = []
        stands: dict[int, int] = {}
        for r, names in zip(home, _ints(home, "classes", np.int64), strict=True):
            other = names[np.fromiter((stands.setdefault(x, r["part"]) != r["part"] for x in names.tolist()), bool, len(names))]
            if len(other):
                out.append((3, None, r["part"], other, None, None, None, None))
        first: dict[int, int] = {}
        masks, all_names, all_counts, items = [], _ints(dealt, "classes", np.int64), _ints(dealt, "counts", np.int32), _ints(dealt, "items", np.uint64)
        for k, (names, counts) in enumerate(zip(all_names, all_counts, strict=True)):
            fresh_ones = np.fromiter((first.setdefault(x, k) == k for x in names.tolist()), bool, len(names))
            masks.append(np.repeat(fresh_ones, counts))
        del first
        order = _joined_up([x[m] for x, m in zip(items, masks, strict=True)], np.uint64)
        order.sort()
        if hot:
            few, n = np.unique(order, return_counts=True)
            values, at = np.unique(np.concatenate([few, *_ints(hot, "items", np.uint64)]), return_inverse=True)
            times = np.bincount(at, np.concatenate([n, *_ints(hot, "counts", np.int64)]))
            shared, times = values[times > 1], times[times > 1]
        else:
            shared = np.unique(order[1:][order[1:] == order[:-1]])
            times = np.searchsorted(order, shared, side="right") - np.searchsorted(order, shared)
        del order
        if len(shared):
            spread = np.minimum(times, 0xFFFF).astype(np.uint16)
            for r, x in zip(hot, _ints(hot, "items", np.uint64), strict=True):
                out.append((2, None, r["part"], None, None, None, x, spread[np.searchsorted(shared, x)]))
            for r, names, counts, x, m in zip(dealt, all_names, all_counts, items, masks, strict=True):
                at = np.minimum(np.searchsorted(shared, x), len(shared) - 1)
                hit = m & (shared[at] == x)
                if hit.any():
                    n = np.bincount(np.repeat(np.arange(len(names)), counts)[hit], minlength=len(names)).astype(np.int32)
                    some = n > 0
                    out.append((0, None, r["part"], names[some], np.frombuffer(r["sizes"], np.int32)[some], n[some], x[hit], spread[at[hit]]))
        if out:
            yield _packed(out)


def _gather(percent: int):
    """For each part: the classes that it stands for and of whose items enough are shared: their items frequent first,
    and the prefix's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "part"):
            dealt, straight, hot, others = ([r for r in rows if r["kind"] == k] for k in (0, 1, 2, 3))
            spreads = _ints(dealt, "spread", np.uint16)
            if straight:
                known, of = _joined_up(_ints(hot, "items", np.uint64), np.uint64), _joined_up(_ints(hot, "spread", np.uint16), np.uint16)
                order = np.argsort(known)
                known, of = known[order], of[order]
                spreads += [of[np.searchsorted(known, x)] for x in _ints(straight, "items", np.uint64)]
            both = dealt + straight
            if not both:
                continue
            names, sizes = np.concatenate(_ints(both, "classes", np.int64)), np.concatenate(_ints(both, "sizes", np.int32))
            counts, items = np.concatenate(_ints(both, "counts", np.int32)), np.concatenate(_ints(both, "items", np.uint64))
            mine = ~np.isin(names, _joined_up(_ints(others, "classes", np.int64), np.int64))
            of_mine = np.repeat(mine, counts)
            # an item's place in the global order: frequent first, then by hash, of which 48 bits are left
            place = ((np.uint64(0xFFFF) - np.concatenate(spreads).astype(np.uint64)) << np.uint64(48) | items >> np.uint64(16))[of_mine]
            size_of = dict(zip(names[mine].tolist(), sizes[mine].tolist(), strict=True))
            owner = np.repeat(names[mine], counts[mine])
            order = np.argsort(owner, kind="stable")
            owner, place = owner[order], place[order]
            edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True]))) if len(owner) else []
            out = []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                name = int(owner[a])
                n, least = size_of[name], -(-percent * size_of[name] // 100)
                if b - a >= least:
                    own = np.sort(place[a:b])
                    rare = (n - least + 1) - (n - len(own))  # items of the prefix that aren't the class's own
                    out.append((name, n, own.tobytes(), own[len(own) - rare :].view(np.int64).tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())], strict=True)], ["class", "size", "items", "prefix"])

    return run


class _Node:
    __slots__ = ("segment", "children", "sets", "least", "deepest", "sample", "mixed")

    def __init__(self, segment, sample, size):
        self.segment, self.children, self.sets = segment, {}, []
        self.least, self.deepest, self.sample, self.mixed = size, 0, sample, False


class PrefixTree:
    """Sets as ascending places; ``add`` finds the links of a set with those before it, and then stores it.

    ``root[i]`` is a union-find over the sets. A link to a set that is already connected need not be found.
    """

    def __init__(self, percent: int):
        self.percent, self.top = percent, _Node(np.empty(0, np.uint64), -1, 1 << 60)
        self.sets: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.root: list[int] = []

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def add(self, places: np.ndarray, size: int, joined: int | None = None) -> int:
        """``joined``: a set before it that is known to be connected with this one."""
        me = len(self.sets)
        self.sets.append(places)
        self.sizes.append(size)
        self.root.append(me)
        if joined is not None:
            self.union(me, joined)
        self._search(me)
        self._insert(me)
        return me

    def _search(self, me: int) -> None:
        q, size, percent = self.sets[me], self.sizes[me], self.percent
        n, stack = len(q), [(c, 0) for c in self.top.children.values()]
        own = self.top.children.get(int(q[0])) if n else None
        if own is not None:
            stack.append((own, 0))  # the path of the query's own items first
        seen_own = False
        while stack:
            node, overlap = stack.pop()
            if node is own:
                if seen_own:
                    continue
                seen_own = True
            if not node.mixed and self.find(node.sample) == self.find(me):
                continue
            # o links sizes a and b if 100 * o >= percent * (a + b - o)
            need = -(-percent * (size + node.least) // (100 + percent))
            segment = node.segment
            at = np.searchsorted(q, segment)
            inside = at < n
            overlap += int((q[at[inside]] == segment[inside]).sum())
            left = n - int(np.searchsorted(q, segment[-1], side="right"))
            for j in node.sets:
                if (100 + percent) * overlap >= percent * (size + self.sizes[j]):
                    self.union(me, j)
            if overlap + min(left, node.deepest) < need:
                continue
            stack += [(c, overlap) for c in node.children.values()]

    def _insert(self, me: int) -> None:
        places, size, node, at = self.sets[me], self.sizes[me], self.top, 0
        while True:
            if node is not self.top:
                node.mixed = node.mixed or self.find(node.sample) != self.find(me)
            node.least = min(node.least, size)
            node.deepest = max(node.deepest, len(places) - at)
            if at == len(places):
                node.sets.append(me)
                return
            child = node.children.get(int(places[at]))
            if child is None:
                child = node.children[int(places[at])] = _Node(places[at:], me, size)
                child.sets.append(me)
                return
            m = min(len(child.segment), len(places) - at)
            differ = np.flatnonzero(child.segment[:m] != places[at : at + m])
            common = int(differ[0]) if len(differ) else m
            if common < len(child.segment):  # split the child's segment
                upper = _Node(child.segment[:common], child.sample, child.least)
                upper.mixed, upper.deepest = child.mixed, child.deepest + len(child.segment) - common
                child.segment = child.segment[common:]
                upper.children[int(child.segment[0])] = child
                node.children[int(places[at])] = upper
                child = upper
            node, at = child, at + common


def _links(percent: int):
    """Rows (a, b): each class of a block and another that it is connected with, where the block's links join them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "leader", "block"):
            tree, names, before = PrefixTree(percent), [], {}
            for r in rows:
                at = tree.add(np.frombuffer(r["items"], np.uint64), r["size"], before.get(r["component"]))
                before.setdefault(r["component"], at)
                names.append(r["class"])
            pairs = [(names[i], names[tree.find(i)]) for i in range(len(names)) if tree.find(i) != i]
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


#: Parts into which the rows of a hot node or label are dealt, and the share of all edges (1 / HOT) that makes a node hot.
SALTS, HOT = 16, 2000


def _salted(edges: DataFrame) -> DataFrame:
    """Both directions of the edges with a ``salt``: edges into a hot node are dealt over SALTS parts by their other end.
    Fewer than HOT nodes can be hot, which bounds the broadcast."""
    both = table(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    least = max(1000, both.count() // HOT)
    hot = both.groupBy(F.col("b").alias("hot")).agg(F.count("*").alias("n")).where(F.col("n") > least).select("hot")
    salt = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("a"), F.lit(SALTS))).otherwise(0).cast("int")
    return table(both.join(F.broadcast(hot), both["b"] == hot["hot"], "left").select("a", "b", salt.alias("salt")), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the least node reachable.

    Every round takes the least label among the neighbours, then the label of the label; rounds are written to the
    shared folder. Rounds grow with the logarithm of the longest shortest path. Labels of hot nodes are repeated for each
    salt, and so are those labels of labels that still move, so that no node and no label meets all its rows in one task.
    """
    both = _salted(edges)
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    hot = table(both.where("salt > 0").select("b", "salt").distinct(), "hot")
    while True:
        more = hot.join(labels, hot["b"] == labels["node"]).select("node", "component", "salt")
        at = labels.select("node", "component", F.lit(0).alias("salt")).unionByName(more)
        near = both.join(at, (both["b"] == at["node"]) & (both["salt"] == at["salt"])).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        best = table(labels.join(near, "node", "left").select("node", "component", F.least("component", "near").alias("best")), "near")
        used = best.select(F.col("best").alias("up")).distinct()
        up = best.where("best != node").join(used, F.col("node") == F.col("up")).select("up", F.col("best").alias("further"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
        mine = best.withColumn("mine", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
        new = mine.join(up, (F.col("best") == F.col("up")) & (F.col("mine") == F.col("part")), "left").select("node", F.least("best", "further").alias("component"), "component")
        moved = F.col("component") != F.col("before")
        new = table(new.toDF("node", "component", "before").select("node", "component", moved.alias("moved")), "labels")
        drop(best, labels)
        labels = new
        if not new.where("moved").limit(1).count():
            return new.select("node", "component")


def _joined(sets: DataFrame, members: DataFrame, percent: int, bytes_: int) -> DataFrame:
    """Links of the blocks (leader, block, class, component) of ``members``, whose sets (class, size, items) have about
    ``bytes_``."""
    rows = members.join(sets.select("class", "size", "items"), "class").select("leader", "block", "class", "component", "size", "items")
    rows = rows.repartition(max(8, ceil(bytes_ / TASK_BYTES)), "leader", "block").sortWithinPartitions("leader", "block", "class")
    return rows.mapInArrow(Tidy(_links(percent)), "a long, b long")


def similar_classes(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(node, component) over classes, for every class that has a link (or whose group has)."""
    buckets = max(8, ceil(text_bytes(docs, text) / BUCKET_TEXT))
    dealt = docs.select(*quoted(text)).mapInArrow(Tidy(_deal(buckets), _forget), PACKED)
    counted = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(Tidy(_count), PACKED)
    gathered = counted.repartition(buckets, "part").sortWithinPartitions("part").mapInArrow(Tidy(_gather(percent)), "class long, size long, items binary, prefix array<long>")
    sets = table(gathered, "sets")
    tokens = sets.select("class", F.explode("prefix").alias("token"))
    leaders = tokens.groupBy("token").agg(F.min("class").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = table(tokens.join(leaders, "token").select("leader", "class").distinct(), "members")
    weight = F.col("size") * 8
    sizes = members.join(sets.select("class", "size"), "class").groupBy("leader").agg(F.count("*").alias("n"), F.sum(weight).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    groups = table(sizes.where("n > 1").select("leader", "bytes", blocks.alias("blocks")), "groups")
    volume = groups.agg(F.sum("bytes")).first()[0] or 0
    of_group = members.join(groups, "leader")
    own = F.pmod(F.xxhash64("class"), "blocks").cast("int")
    placed = of_group.withColumn("block", F.explode(F.when(F.col("class") == F.col("leader"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))
    # without a component, a class stands for itself
    edges = table(_joined(sets, placed.select("leader", "block", "class", F.col("class").alias("component")), percent, volume), "links")
    labels = components(edges)
    if groups.where("blocks > 1").limit(1).count():
        known = labels.withColumnRenamed("node", "class")
        large = of_group.where("blocks > 1").join(known, "class", "left").withColumn("component", F.coalesce("component", "class"))
        large = table(large, "large")
        open_ones = table(large.groupBy("leader").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("leader"), "open")
        rest = large.join(open_ones, "leader").withColumn("own", own)
        other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("own")))
        rest = rest.withColumn("other", other).withColumn("block", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
        volume = groups.join(open_ones, "leader").agg(F.sum(F.col("bytes") * (F.col("blocks") - 1))).first()[0] or 0
        more = table(_joined(sets, rest.select("leader", "block", "class", "component"), percent, volume), "links")
        if more.limit(1).count():
            labels = components(edges.union(more))
        drop(large, open_ones)
    drop(members, groups, sets)
    return labels


def _with_classes(docs: DataFrame, text: str, columns: list[str], to: str) -> DataFrame:
    """The columns and ``to``, a struct of each row's class and number of shingles, as a table."""
    return table(docs.select(*quoted(*columns), F.arrow_udf(_classes, CLASS)(*quoted(text)).alias(to)), "classes")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; component_id is the least doc_id reachable by links.

    Null, empty and blank texts have an empty set and no link; texts of fewer words than a shingle are one shingle;
    texts of any length are taken whole. Every row is a document: rows that share an id but not a text are linked only
    if their texts are. A row without an id takes part in links, but lends no id to its component; an empty table gives
    an empty result; other columns are ignored. Sets are compared by 64-bit hashes of shingles (48 bits beside the count
    within a group), classes by 63 bits.
    """
    prepare(docs.sparkSession)
    named = docs.select(quoted(doc_id)[0].cast("long").alias("doc_id"), quoted(text)[0].alias("text"))
    own = _with_classes(named, "text", ["doc_id"], "c").select("doc_id", F.col("c.class").alias("class"), F.col("c.size").alias("size"))
    labels = similar_classes(named, "text", percent)
    per_class = own.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    linked = per_class.join(labels, per_class["class"] == labels["node"], "left").select("class", "least", "n", F.coalesce("component", "class").alias("component"))
    linked = table(linked.where("n > 1 OR component != class").union(linked.join(labels.select("component").distinct(), "component", "left_semi").where("n = 1 AND component = class").select("class", "least", "n", "component")), "linked")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    names = linked.join(least, "component").select(F.col("class").alias("c"), "component_id")
    return own.join(names, own["class"] == names["c"], "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` but for near copies: of each component one row stays, that with the least id (a row without an
    id only where none has one; of several with that id, one). Rows, not ids, are dropped, so a text that resembles no
    other stays whatever id it has. Rows without a word stay all; an empty table stays empty; the columns, whatever
    their names, are those of ``docs``."""
    prepare(docs.sparkSession)
    own = fresh(docs.columns, "class", "row", "gone")
    kept, row = quoted(*docs.columns), F.col(own["row"])
    rows = _with_classes(docs.withColumn(own["row"], F.monotonically_increasing_id()), text, [*docs.columns, own["row"]], own["class"])
    labels = similar_classes(docs, text, percent)
    narrow = rows.select(F.col(f"{own['class']}.class").alias("class"), quoted(doc_id)[0].cast("long").alias("id"), row.alias("row")).where("class IS NOT NULL")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    per_class = table(narrow.groupBy("class").agg(best, F.count("*").alias("n")), "per-class")
    of = per_class.join(labels, per_class["class"] == labels["node"], "left").select("class", "best", "n", F.coalesce("component", "class").alias("component"))
    won = of.groupBy(F.col("component").alias("won")).agg(F.min("best").alias("first"))
    # classes of several rows, or whose component another class's row stands for; the winner's row, if it is one of theirs
    stays = of.join(won, F.col("component") == F.col("won")).where("n > 1 OR best.row != first.row").select("class", F.col("first.row").alias("first"))
    stays = table(stays, "stays")
    gone = narrow.join(stays, "class").where("row != first").select(F.col("row").alias(own["gone"]))
    gone = table(gone, "gone")
    out = rows.join(gone.hint("shuffle_hash"), row == F.col(own["gone"]), "left_anti")
    return out.select(*kept)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


#: All pairs that share a shingle, and their links' closure.
OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n FROM d),
g AS (SELECT r, i, n, CASE WHEN n < 5 THEN string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ELSE word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o END AS shingle
  FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
s AS MATERIALIZED (SELECT DISTINCT r, md5_number(shingle) AS h FROM g WHERE shingle IS NOT NULL AND (n >= 5 OR i = 1)),
c AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM s x JOIN s y ON x.h = y.h AND x.r < y.r GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN c x ON x.r = a JOIN c y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
t AS (SELECT r, doc_id AS root FROM d UNION SELECT l.b, t.root FROM t JOIN l ON l.a = t.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, root AS component_id FROM d JOIN (SELECT r, min(root) AS root FROM t GROUP BY r) USING (r) LEFT JOIN c USING (r)
"""
