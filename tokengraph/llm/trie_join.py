"""Documents whose sets of word n-grams are nearly equal, joined by prefix trees.

Equal sets are linked by their digest. Documents meet only where they agree in a whole part of their sets: the range of
hashes is cut into one part more than two linked sets of such a size can differ in n-grams, so they agree in at least one,
and common passages alone make no one meet. Each document lives in one tree, that of its near copies as far as the
agreeing parts tell, and is sent to the trees in which others that it agrees with live. A tree stores its sets in the
order of their frequency there, so near copies share long paths; it is walked with the partial overlap so far, and a
branch is left as soon as the lengths below it can no longer reach the threshold. Links become components in rounds of
smallest labels over tables.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokengraph.llm import common as C

SIZE, PERCENT = 3, 90
TREE_SETS, BUCKET_ENTRIES = 1_500, 2_000_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def grams(text: str, size: int = SIZE) -> np.ndarray:
    """Distinct hashes of the word n-grams, ascending; fewer words than ``size`` are one n-gram, no word is none."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    n, size = len(words), min(size, len(words))
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    ends = np.flatnonzero(data == 32) + 1
    starts = np.concatenate([[0], ends[:-1]])[: n - size + 1]
    return np.unique(C.span_hashes(data, starts, ends[size - 1 :]))


def least_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """The smallest intersection with which sets of these sizes link: ``100 i >= percent (n + m - i)``."""
    return -(-percent * (n + m) // (100 + percent))


@cache
def class_starts(percent: int, most: int) -> list[int]:
    """Sizes at which size classes begin: sets that link are in one class or in neighbouring ones."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return out


@cache
def parts_of(level: int, percent: int) -> int:
    """Parts for sets of class ``level`` and the next: one more than two linked ones can differ in n-grams."""
    starts = class_starts(percent, 1 << 40)
    most = starts[level + 2] - 1
    return 2 * most * (100 - percent) // (100 + percent) + 1


def most_differences(n: int, percent: int = PERCENT) -> int:
    """N-grams in which a set of ``n`` and any set that links with it differ at most."""
    return (100 - percent) * (n + n * 100 // percent) // (100 + percent)


def signatures(h: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash for each part of a set of ascending hashes, in the partition of its size class and of the class below, with
    the class and the number of them that any linked set of that partition has as well.

    A differing n-gram spoils one part. There are more parts than differences, by a quarter, and empty parts count only
    where too few are filled to be sure of one without them.
    """
    n = len(h)
    out, levels, needs = [], [], []
    own = bisect_right(class_starts(percent, 1 << 40), n) - 1
    mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed ^ (mixed >> np.uint64(31)))])
    for level in range(max(0, own - 1), own + 1) if n else ():
        least = parts_of(level, percent)
        parts = least + least // 4 + 1
        inner = np.arange(1, parts, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // parts)
        cuts = np.concatenate([[0], np.searchsorted(h, inner), [n]])
        filled = np.diff(cuts) > 0
        s = sums[cuts[1:]] - sums[cuts[:-1]] + np.diff(cuts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        s += np.arange(parts, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(level * 0x165667B19E3779F9 % (1 << 64))
        s = (s ^ (s >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        s ^= s >> np.uint64(32)
        sure = int(filled.sum()) - most_differences(n, percent)
        if filled.sum() >= least:  # so at least one filled part is left unspoiled, and the other set sends it, too
            s = s[filled]
        out.append(s)
        levels.append(np.full(len(s), level, np.int16))
        needs.append(np.full(len(s), max(1, sure), np.int32))
    return tuple(np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((out, np.uint64), (levels, np.int16), (needs, np.int32)))


class Tree:
    """A compressed prefix tree of sets, walked with one probe at a time; keeps what is linked already together."""

    def __init__(self, members: list[tuple[int, np.ndarray]], percent: int = PERCENT):
        self.percent = percent
        self.parent: dict[int, int] = {}
        everything = np.concatenate([s for _, s in members])
        words, counts = np.unique(everything, return_counts=True)
        order = np.lexsort((words, -counts))
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.words, self.place, self.hit = words, place, np.zeros(len(words) + 1, bool)
        sets = sorted((tuple(np.sort(place[np.searchsorted(words, s)]).tolist()), d) for d, s in members)
        # node: ranks on the edge into it, first child, next sibling, members that end here, least and most size below
        self.edge, self.kids, self.own, self.low, self.high, self.one = [], [], [], [], [], []
        self.root = self._build(sets, 0, len(sets), 0)

    def _build(self, sets: list, a: int, b: int, depth: int) -> int:
        """Node of ``sets[a:b]``, which agree in the first ``depth`` ranks; written without recursion per rank."""
        node = self._node([], sets, a, b)
        todo = [(node, a, b, depth)]
        while todo:
            at, a, b, depth = todo.pop()
            while a < b and len(sets[a][0]) == depth:
                self.own[at].append((sets[a][1], depth))
                a += 1
            while a < b:
                first = sets[a][0][depth]
                end = a + 1
                while end < b and sets[end][0][depth] == first:
                    end += 1
                x, y = sets[a][0], sets[end - 1][0]
                deep, most = depth + 1, min(len(x), len(y))
                while deep < most and x[deep] == y[deep]:
                    deep += 1
                kid = self._node(list(x[depth:deep]), sets, a, end)
                self.kids[at].append(kid)
                todo.append((kid, a, end, deep))
                a = end
        return node

    def _node(self, edge: list, sets: list, a: int, b: int) -> int:
        sizes = [len(s) for s, _ in sets[a:b]]
        self.edge.append(np.array(edge, np.int64))
        self.kids.append([])
        self.own.append([])
        self.low.append(min(sizes))
        self.high.append(max(sizes))
        self.one.append(sets[a][1] if b - a == 1 else None)
        return len(self.edge) - 1

    def find(self, d: int) -> int:
        p = self.parent
        while (up := p.setdefault(d, d)) != d:
            p[d] = d = p[up]
        return d

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def _alike(self, node: int) -> int | None:
        """A member below the node if all below are in one component; remembered, as components only grow."""
        if self.one[node] is None:
            roots = {self.find(d) for d, _ in self.own[node]}
            for kid in self.kids[node]:
                if len(roots) > 1:
                    break
                d = self.one[kid] if self.one[kid] is not None else None
                if d is None:
                    return None
                roots.add(self.find(d))
            if len(roots) == 1:
                self.one[node] = roots.pop()
        return self.one[node]

    def probe(self, doc: int, s: np.ndarray) -> None:
        """Link ``doc`` with every component of the tree that holds a set similar enough."""
        n = len(s)
        at = np.searchsorted(self.words, s)
        at[at == len(self.words)] = 0
        ranks = np.sort(self.place[at[self.words[at] == s]])
        outside = n - len(ranks)  # n-grams of the probe that no set here has
        self.hit[ranks] = True
        todo = [(self.root, 0, 0)]  # node, overlap, depth
        walked = []
        while todo:
            node, overlap, depth = todo.pop()
            same = self._alike(node)
            if same is not None and self.find(same) == self.find(doc):
                continue
            edge = self.edge[node]
            if len(edge):
                overlap += int(np.count_nonzero(self.hit[edge]))
                depth += len(edge)
                # no set below keeps more than its own size less what it missed, nor more than the probe has left
                missed = depth - overlap
                passed = outside + int(np.searchsorted(ranks, edge[-1], side="right")) - overlap
                if self.high[node] - missed < least_overlap(n, self.high[node], self.percent) or n - passed < least_overlap(n, self.low[node], self.percent):
                    continue
            for d, size in self.own[node]:
                if d != doc and overlap >= least_overlap(n, size, self.percent):
                    self.union(doc, d)
            walked.append(node)
            todo += [(kid, overlap, depth) for kid in reversed(self.kids[node])]
        for node in reversed(walked):
            self._alike(node)
        self.hit[ranks] = False


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n, set_key``: size and digest of the set of every row (digest null for an empty set)."""

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                sets = [grams(t, size) for t in b.column("text").to_pylist()]
                keys = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(h) for h in sets], pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "n", "set_key"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, set_key binary")


def agreeing(docs: DataFrame, size: int, percent: int, n_buckets: int) -> DataFrame:
    """``doc_id, n, g, level, need, c``: the signatures that more than one document has, with their number ``c``.

    Documents with fewer of them than any linked document would share with them are left out.

    Of equal sets among 2,048 neighbouring rows only the first is sent, so a group of copies is a few rows per task.
    Signatures are dealt to buckets as packed arrays and sorted there.
    """

    def deal(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                b, seen, ids, sizes, parts = whole.slice(i, 2048), set(), [], [], []
                for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    h = grams(t, size)
                    key = h.tobytes() if len(h) < 4 else xxhash.xxh3_128_digest(h.tobytes())
                    if len(h) and key not in seen:
                        seen.add(key)
                        ids.append(d)
                        sizes.append(len(h))
                        parts.append(signatures(h, percent))
                if not parts:
                    continue
                # one row per document and level: id, size, level, signatures a linked document has as well
                row, docs, k = [], [], -1
                for d, n, (s, level, need) in zip(ids, sizes, parts):
                    new = np.concatenate([[True], level[1:] != level[:-1]])
                    row.append(np.cumsum(new) + k)
                    k = int(row[-1][-1])
                    docs.append(np.stack([np.full(new.sum(), d), np.full(new.sum(), n), level[new], need[new]]).astype(np.int64))
                row, g, docs = np.concatenate(row), np.concatenate([s for s, _, _ in parts]), np.concatenate(docs, axis=1)
                bucket = g % np.uint64(n_buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=np.uint64))
                made: list[list] = [[], [], [], []]
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    own = order[cuts[k] : cuts[k + 1]]
                    rows, at = np.unique(row[own], return_inverse=True)
                    for column, value in zip(made, (k, g[own].tobytes(), C.pack(at.astype(np.uint16)), C.pack(docs[:, rows]))):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.int32()), *[pa.array(m, pa.binary()) for m in made[1:]]], names=["bucket", "g", "at", "docs"])

    def meet(batches):
        for _, rows in C.in_groups(C.rows_of(batches, 16), lambda r: r["bucket"]):
            g, doc = [], []
            for r in rows:
                g.append(np.frombuffer(r["g"], np.uint64))
                doc.append(C.unpack(r["docs"], np.int64).reshape(4, -1)[:, C.unpack(r["at"], np.uint16)])
            g, doc = np.concatenate(g), np.concatenate(doc, axis=1)
            order = np.argsort(g, kind="stable")
            s = g[order]
            group = np.cumsum(np.concatenate([[0], (s[1:] != s[:-1]).astype(np.int64)]))
            c = np.bincount(group)[group]
            pick = c > 1
            order, c = order[pick], c[pick]
            doc = doc[:, order]
            yield pa.RecordBatch.from_arrays([pa.array(doc[0]), pa.array(doc[1]), pa.array(g[order].view(np.int64)), pa.array(doc[2]), pa.array(doc[3]), pa.array(c)], names=["doc_id", "n", "g", "level", "need", "c"])

    dealt = docs.mapInArrow(deal, "bucket int, g binary, at binary, docs binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "doc_id bigint, n bigint, g bigint, level bigint, need bigint, c bigint")


def homes(shared: DataFrame) -> DataFrame:
    """``doc_id, home``: near copies mostly get the same home.

    First the part that most others agree in; then, as an edit may have hit just that one, the home that most of the own
    parts stand for, a part standing for the home of most documents that have it.
    """
    first = shared.groupBy("doc_id").agg(F.max(F.struct("c", "g"))["g"].alias("home"))
    stands = shared.select("doc_id", "g").join(first, "doc_id").groupBy("g", "home").agg(F.count("*").alias("k")).groupBy("g").agg(F.max(F.struct("k", "home"))["home"].alias("home"))
    votes = shared.select("doc_id", "g").join(stands, "g").groupBy("doc_id", "home").agg(F.count("*").alias("k"))
    return votes.groupBy("doc_id").agg(F.max(F.struct("k", "home"))["home"].alias("home"))


def links(docs: DataFrame, grams_in_all: int, size: int, percent: int, tree_sets: int) -> DataFrame:
    """``doc_id, label``: documents linked in some tree, with the smallest they were found together with there."""
    # about this many signatures: two partitions of a set, each of a part per possible difference
    entries = grams_in_all * 6 * (100 - percent) // (100 + percent)
    found = C.cut(agreeing(docs, size, percent, max(1, -(-entries // BUCKET_ENTRIES))))
    enough = found.groupBy("doc_id", "n", "level").agg(F.count("*").alias("k"), F.max("need").alias("need")).where("k >= need").select("doc_id", "n", "level")
    shared = C.cut(found.join(enough, ["doc_id", "n", "level"]))
    home = C.cut(homes(shared))
    crowd = home.groupBy("home").agg(F.count("*").alias("k"))
    parts = F.ceil(F.col("k") / tree_sets).cast("int")
    home = C.cut(home.join(crowd, "home").select("doc_id", "home", F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part")))
    at = shared.join(home, "doc_id").groupBy("g", "home", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    alike = (F.col("low") * percent <= F.col("n") * 100) & (F.col("high") * 100 >= F.col("n") * percent)
    agree = shared.join(at, "g").where(alike).groupBy("doc_id", "n", "level", "home", "part").agg(F.count("*").alias("k"), F.max("need").alias("need"))
    visits = agree.where("k >= need").select("doc_id", "home", "part").distinct()
    seats = C.cut(home.withColumn("lives", F.lit(0)).unionByName(visits.withColumn("lives", F.lit(1))))
    visited = seats.groupBy("home", "part").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where(F.col("a") != F.col("z")).select("home", "part")
    seats = seats.join(visited, ["home", "part"]).groupBy("doc_id").agg(F.collect_list(F.struct("home", "part", "lives")).alias("seats"))

    def seat(batches):
        for r in C.rows_of(batches, 16):
            h = grams(r["text"], size).tobytes()
            k = len(r["seats"])
            for i in range(0, k, 64):
                some = r["seats"][i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array([s["home"] for s in some], pa.int64()), pa.array([s["part"] for s in some], pa.int32()), pa.array([s["lives"] for s in some], pa.int32()), pa.array([r["doc_id"]] * len(some), pa.int64()), pa.array([h] * len(some), pa.binary())], names=["home", "part", "lives", "doc_id", "grams"])

    # the seats grow with the input: never broadcast, the same plan at every size
    seated = docs.join(seats.hint("merge"), "doc_id").mapInArrow(seat, "home bigint, part int, lives int, doc_id bigint, grams binary")

    def walk(batches):
        for _, rows in C.in_groups(C.rows_of(batches, 64), lambda r: (r["home"], r["part"])):
            members, tree, seen = [], None, []
            for r in rows:
                s = np.frombuffer(r["grams"], np.uint64)
                if not r["lives"]:
                    members.append((r["doc_id"], s))
                    continue
                if tree is None:
                    tree = Tree(members, percent)
                seen.append(r["doc_id"])
                tree.probe(r["doc_id"], s)
            if tree is not None:
                found = [(d, tree.find(d)) for d in {*seen, *(d for d, _ in members)}]
                found = [(d, root) for d, root in found if d != root]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], names=["doc_id", "label"])

    return seated.repartition("home", "part").sortWithinPartitions("home", "part", "lives", "doc_id").mapInArrow(walk, "doc_id bigint, label bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``doc_id, component``: every end of an edge with the smallest id it is connected to.

    Each round every node takes the smallest label among its neighbours and then the label of its label; labels are a
    table in the shared folder after each round. A component of diameter d is done after about log d rounds.
    """
    both = C.cut(edges.select("doc_id", "label").unionByName(edges.select(F.col("label").alias("doc_id"), F.col("doc_id").alias("label"))).distinct())
    labels = C.cut(both.groupBy("doc_id").agg(F.min("label").alias("m")).select("doc_id", F.least("doc_id", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("doc_id", "label"), "label").groupBy("doc_id").agg(F.min("component").alias("near"))
        step = labels.join(near, "doc_id").select("doc_id", "component", F.least("component", "near").alias("next"))
        step = C.cut(step)
        jump = step.select(F.col("doc_id").alias("next"), F.col("next").alias("jump"))
        moved = C.cut(step.join(jump, "next", "left").select("doc_id", F.least("next", F.coalesce("jump", "next")).alias("component"), F.col("component").alias("before")))
        labels = moved.select("doc_id", "component")
        if moved.where("component != before").isEmpty():
            return labels


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, tree_sets: int = TREE_SETS) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per input row.

    A null or empty text has an empty set and is its own component, as is a row without an id (component null). Rows that
    share an id are one node: their sets are all compared. Equal sets are linked. Other columns are not carried.
    """
    src = C.texts(docs)
    made = C.cut(sets_of(src, size))
    usable = made.where("set_key is not null and doc_id is not null")
    first = usable.groupBy("set_key").agg(F.min("doc_id").alias("label"), F.max("doc_id").alias("last")).where("label != last").drop("last")
    same_set = usable.select("set_key", "doc_id").join(first, "set_key").where("doc_id != label").select("doc_id", "label")
    total = usable.agg(F.sum("n")).first()[0] or 0
    edges = links(src.where("doc_id is not null"), total, size, percent, tree_sets).unionByName(same_set)
    found = components(edges)
    return made.join(found, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that have a smaller id in their component; all columns as they are. Rows without an id stay."""
    key = "__trie_join_id"
    gone = join(docs, size, percent).where("component_id != doc_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(C.cut(gone), docs["doc_id"].cast("long") == F.col(key), "left_anti")
