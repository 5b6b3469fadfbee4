"""Near duplicates by chosen-path set similarity join, with links confirmed on whole shingle sets.

1. Every text becomes its set of shingles; equal sets become one class, so copies cost one row each and no pair.
2. Each class has ``COORDINATES`` minwise tokens. In a tree, a node chooses one coordinate, and with probability
   ``EXTRA`` a second one, by a hash of the node alone; classes branch to the children that their minwise tokens at those
   coordinates name.
3. The depth is measured over all classes (``depth_of``): branching ends where one more level would no longer halve large
   nodes, but for a share of ``SHARE`` of the classes. As many independent trees are grown as the target recall needs for a
   pair of the threshold's similarity at just that depth.
4. In each node every member is compared, by sketches, with the members of its block (the whole node, unless it has more
   than ``SIDE`` members); the most promising pair of each class is confirmed. That makes components of most groups.
5. Small nodes that still hold several components are compared exhaustively across components. Large nodes, and small ones in
   which more pairs pass the sketch than there are members, hold texts that share a large part whether they are linked or
   not. Their members leave the trees and are joined exactly, all of them at once, by their rarest shingles: two sets of the
   threshold's similarity share one of the rarest fifth of the larger and of the rarest ninth of the smaller. Texts made
   from one template share what is frequent, so that as long as they are no near copies they meet nowhere, however many.
6. A pair must pass a sketch of ``SKETCH`` bytes (5 standard deviations of slack), then the whole sets decide.

No step collects ids, links or components; the driver sees counts only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import components
from .common import Scratch, hash_words, mix64, slices, small_batches, table

COORDINATES = 128
SKETCH = 128
EXTRA = 0.1
#: Pairs that a small node may give for each of its members; above, they are joined by their rarest shingles.
CROSS = 1
#: Members of a block, and of a small node.
SIDE = 256
#: Counters of shingles by hash, which order them from rare to frequent. Any order gives the same links.
SLOTS = 1 << 20
#: Sets from which on a token is one of many, and how many of these a set names as met before.
MANY = 16
BEFORE = 32
#: Nodes above this size are large when the depth is measured, and SHARE is the part of the classes that may stay in them.
NODE = 64
SHARE = 0.01
#: Deepest level.
MAX_LEVELS = 12
THRESHOLD = 0.8
SHINGLE = 2
RECALL = 0.9999
_K = np.uint64(0x9E3779B97F4A7C15)


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the minwise hash functions."""
    i = np.arange(1, COORDINATES + 1, dtype=np.uint64)
    return mix64(i * _K) | np.uint64(1), mix64(i * _K + np.uint64(77))


_A, _B = coefficients()


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of shingles of ``size`` words; of all words where they are fewer; none without words."""
    if len(words) < 2:
        return mix64(words ^ np.uint64(0x5851F42D4C957F2D))
    size = min(size, len(words))
    out = words[: len(words) - size + 1]
    for k in range(1, size):
        out = mix64(out * _K + words[k : len(words) - size + 1 + k])
    return np.unique(out)


def text_shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    return shingles(hash_words(text.lower().split()), size)


def set_id(s: np.ndarray) -> int:
    """64-bit id of a set, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def text_hash(text: bytes) -> int:
    """Spark's xxhash64 of a binary."""
    return int(np.uint64(xxhash.xxh64_intdigest(text, seed=42)).astype(np.int64))


def minwise(s: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set (uint32)."""
    least = np.full(COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(s), 2048):
        np.minimum(least, (s[a : a + 2048, None] * _A + _B).min(0), out=least)
    return (mix64(least) >> np.uint64(32)).astype(np.uint32)


def sets_of(size: int):
    """doc_id, th (Spark's xxhash64 of the text), n_shingles, sid and minwise tokens of each text; null sid for an empty set.
    Texts are lower-cased in A-Z."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for ids, texts in slices(rows["doc_id"], rows["text"]):
                split = [t.lower().split() for t in texts]
                words = hash_words([w for s in split for w in s])
                out, at = [], 0
                for i, t, s in zip(ids, texts, split, strict=True):
                    x = shingles(words[at : at + len(s)], size)
                    at += len(s)
                    out.append((i, text_hash(t), len(x), set_id(x) if len(x) else None, minwise(x).tobytes() if len(x) else None))
                frame = pd.DataFrame(out, columns=["doc_id", "th", "n_shingles", "sid", "sig"])
                # Built as nullable integers at once: by way of floats, ids would lose bits wherever a batch has an empty set.
                frame["sid"] = pd.array([x[3] for x in out], dtype="Int64")
                yield frame

    return work


def misses(depth: int, threshold: float, more: float = EXTRA) -> float:
    """Chance that two sets of the threshold's similarity share no node at a depth of one tree."""
    q = 0.0
    for _ in range(depth):
        one = 1 - threshold + threshold * q
        q = (1 - more) * one + more * one * one
    return q


def branch(node: np.ndarray, sig: np.ndarray, row: np.ndarray, more: float) -> tuple[np.ndarray, np.ndarray]:
    """Children (node, row) of nodes; ``sig`` holds minwise tokens by row."""
    first = (node % np.uint64(COORDINATES)).astype(np.int64)
    draw = mix64(node + _K)
    again = (draw >> np.uint64(40)).astype(np.float64) < more * (1 << 24)
    second = (first + 1 + (draw % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    child = lambda n, c, r: mix64(n * _K + (c.astype(np.uint64) << np.uint64(32)) + sig[r, c])
    return np.concatenate([child(node, first, row), child(node[again], second[again], row[again])]), np.concatenate([row, row[again]])


def signatures(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["sig"]), dtype=np.uint32).reshape(-1, COORDINATES)


def paths(levels: int):
    """The nodes of each class on one path without second choices: (level, parent, node), a row for each level and class."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sig = signatures(rows)
            row = np.arange(len(sig))
            node = np.zeros(len(sig), dtype=np.uint64)
            for level in range(1, levels + 1):
                child, _ = branch(node, sig, row, 0.0)
                yield pd.DataFrame({"level": level, "parent": node.view(np.int64), "node": child.view(np.int64)})
                node = child

    return work


def depth_of(classes: DataFrame, n: int) -> int:
    """The least depth at which at most ``SHARE`` of the classes are in large nodes that another level would halve or better.

    Counted over all classes: how many share a node at each level of a path, and how many a class can expect beside it one
    level on. Groups of near copies stay together at any depth and don't count; what counts are texts that share a part.
    """
    steps = classes.select("sig").mapInPandas(paths(MAX_LEVELS + 1), "level int, parent long, node long")
    sizes = steps.groupBy("level", "parent", "node").agg(F.count("*").alias("k"))
    parents = sizes.groupBy("level", "parent").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("sq"))
    halved = (F.col("n") > NODE) & (2 * F.col("sq") <= F.col("n") * F.col("n"))
    found = {r.level - 1: r.n for r in parents.groupBy("level").agg(F.sum(F.when(halved, F.col("n")).otherwise(0)).alias("n")).collect()}
    return next((d for d in range(1, MAX_LEVELS) if found.get(d, 0) <= SHARE * n), MAX_LEVELS)


def grown(trees: int, depth: int, more: float):
    """Nodes at ``depth`` of all trees for each class: (node, sid)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sig = signatures(rows)
            sid = rows["sid"].to_numpy(dtype=np.int64)
            for t in range(trees):
                row = np.arange(len(sid))
                node = np.repeat(mix64(np.array([t + 1], dtype=np.uint64) * _K), len(sid))
                for _ in range(depth):
                    node, row = branch(node, sig, row, more)
                yield pd.DataFrame({"node": node.view(np.int64), "sid": sid[row]})

    return work


def low_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lowest byte of each of the first ``SKETCH`` minwise tokens."""
    for rows in batches:
        x = signatures(rows)[:, :SKETCH].astype(np.uint8)
        yield pd.DataFrame({"sid": rows["sid"], "sketch": [r.tobytes() for r in x]})


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows as frames of whole groups, with the number of the group by row. A group is at most two blocks."""
    rest: list[pd.DataFrame] = []
    for rows in batches:
        if not len(rows):
            continue
        change = np.flatnonzero((rows[keys].to_numpy()[1:] != rows[keys].to_numpy()[:-1]).any(1))
        same = rest and (rest[-1][keys].iloc[-1].to_numpy() == rows[keys].iloc[0].to_numpy()).all()
        if same and not len(change):
            rest.append(rows)
            continue
        cut = change[-1] + 1 if len(change) else 0
        done = [*rest, rows.iloc[:cut]]
        rest = [rows.iloc[cut:]]
        if any(map(len, done)):
            yield numbered(pd.concat(done, ignore_index=True), keys)
    if rest:
        yield numbered(pd.concat(rest, ignore_index=True), keys)


def numbered(rows: pd.DataFrame, keys: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    k = rows[keys].to_numpy()
    return rows, np.concatenate([[0], np.cumsum((k[1:] != k[:-1]).any(1))]) if len(rows) else np.zeros(0, dtype=np.int64)


def alike(sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of equal bytes of sketches i and j. Lanes of 8 bytes are added up first: SKETCH / 8 is below 256."""
    out = np.empty(len(i), dtype=np.uint64)
    for a in range(0, len(i), 8192):
        same = (sketch[i[a : a + 8192]] == sketch[j[a : a + 8192]]).view(np.uint64).sum(1, dtype=np.uint64)
        out[a : a + 8192] = (same * np.uint64(0x0101010101010101)) >> np.uint64(56)
    return out.astype(np.int32)


def within(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one group, as arrays: those one row apart, two rows apart and so on."""
    i = np.arange(len(group) - 1)
    for step in range(1, len(group)):
        i = i[i < len(group) - step]
        i = i[group[i] == group[i + step]]
        if not len(i):
            return
        yield i, i + step


def best_pairs(least: int, sure: int):
    """The most promising partner of each member of a block: (v, w, same), with the least partner among those that are sure,
    and among equals, so that groups form stars."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, group in whole_groups(batches, ["node", "block"]):
            sid = rows["sid"].to_numpy(dtype=np.int64)
            sketch = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint8).reshape(-1, SKETCH)
            best, mate = np.zeros(len(sid), dtype=np.int32), np.zeros(len(sid), dtype=np.int64)
            for i, j in within(group):
                same = np.minimum(alike(sketch, i, j), sure)
                i, j, same = (x[same >= least] for x in (i, j, same))
                for v, w in ((i, j), (j, i)):
                    better = (same > best[v]) | ((same == best[v]) & (sid[w] < mate[v]))
                    best[v[better]], mate[v[better]] = same[better], sid[w[better]]
            own = best > 0
            yield pd.DataFrame({"v": sid[own], "w": mate[own], "same": best[own]})

    return work


def open_pairs(least: int):
    """Pairs of a node across components that pass the sketch: (a, b). A node with over ``CROSS`` for each member gives its
    members instead: (sid)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, group in whole_groups(batches, ["node"]):
            sid, label = (rows[c].to_numpy(dtype=np.int64) for c in ("sid", "label"))
            sketch = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint8).reshape(-1, SKETCH)
            left, right = [], []
            for i, j in within(group):
                other = label[i] != label[j]
                i, j = i[other], j[other]
                keep = alike(sketch, i, j) >= least
                left.append(i[keep])
                right.append(j[keep])
            i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (left, right))
            n = int(group[-1]) + 1 if len(group) else 0
            dense = np.bincount(group[i], minlength=n) > CROSS * np.bincount(group, minlength=n)
            few = ~dense[group[i]] if len(i) else np.zeros(0, dtype=bool)
            a, b = sid[i[few]], sid[j[few]]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates().assign(sid=None)
            yield pd.DataFrame({"a": None, "b": None, "sid": np.unique(sid[np.concatenate([i[~few], j[~few]])])})

    return work


def slots_of(s: np.ndarray) -> np.ndarray:
    return (s % np.uint64(SLOTS)).astype(np.int64)


def slot_counts(size: int):
    """How many sets of a task hold a shingle of each slot: (slot, n)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros(SLOTS, dtype=np.int64)
        for rows in batches:
            for t in rows["text"]:
                np.add.at(count, slots_of(text_shingles(t, size)), 1)
        slot = np.flatnonzero(count)
        yield pd.DataFrame({"slot": slot, "n": count[slot]})

    return work


def ceiling(a: int, b: int) -> int:
    return -(-a // b)


def rarest(shared, percent: int, size: int):
    """The rarest shingles of each set, as far as two linked sets must share one: (token, sid, label, n, place, head). ``n`` is the
    set's size, ``place`` the token's from rare to frequent, and ``head`` says whether the set, as the smaller of a pair, may
    meet the other there."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = shared.value
        for rows in batches:
            out = []
            for sid, label, t in zip(rows["sid"], rows["label"], rows["text"], strict=True):
                s = text_shingles(t, size)
                n = len(s)
                s = s[np.lexsort((s, frequent[slots_of(s)]))][: n - ceiling(percent * n, 100) + 1].view(np.int64)
                place, same = np.arange(len(s)), np.ones(len(s), dtype=np.int64)
                out.append((s, sid * same, label * same, n * same, place, place <= n - ceiling(2 * percent * n, 100 + percent)))
            if out:
                yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(("token", "sid", "label", "n", "place", "head"), zip(*out, strict=True), strict=True)})

    return work


def meeting(percent: int):
    """Pairs of a token (or of two blocks of its sets) across components that may be linked by their sizes and the token's
    places: (a, b), each once a batch. Pairs that have a rarer token in common, as far as ``before`` names them, have met there."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, group in whole_groups(batches, ["token", "lo", "hi"]):
            sid, label, n, place, lo, hi, block = (rows[c].to_numpy(dtype=np.int64) for c in ("sid", "label", "n", "place", "lo", "hi", "block"))
            head = rows["head"].to_numpy(dtype=bool)
            before = [frozenset(x) for x in rows["before"]]
            found = []
            for i, j in within(group):
                own = (label[i] != label[j]) & ((lo[i] == hi[i]) | (block[i] != block[j]))
                i, j = i[own], j[own]
                first = (n[i] < n[j]) | ((n[i] == n[j]) & (sid[i] < sid[j]))
                small, large = np.where(first, i, j), np.where(first, j, i)
                common = np.minimum(n[i] - place[i], n[j] - place[j])
                own = head[small] & (100 * n[small] >= percent * n[large]) & ((100 + percent) * common >= percent * (n[i] + n[j]))
                i, j = i[own], j[own]
                new = np.array([before[a].isdisjoint(before[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=bool)
                found.append(np.sort(np.stack([sid[i[new]], sid[j[new]]], 1), 1))
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return work


def sketched(least: int):
    """Pairs whose sketches x and y pass: (a, b, same)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x, y = (np.frombuffer(b"".join(rows[c]), dtype=np.uint8).reshape(-1, SKETCH) for c in ("x", "y"))
            i = np.arange(len(rows))
            same = alike(np.concatenate([x, y]), i, i + len(rows))
            keep = same >= least
            yield rows.loc[keep, ["a", "b"]].assign(same=same[keep])

    return work


def confirmed(percent: int, size: int):
    """Pairs whose whole sets have 100 * intersection >= percent * union."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}
        for rows in batches:
            keep = np.zeros(len(rows), dtype=bool)
            for k, (a, b, ta, tb) in enumerate(zip(rows["a"], rows["b"], rows["ta"], rows["tb"], strict=True)):
                both = []
                for i, t in ((a, ta), (b, tb)):
                    if i not in known:
                        if len(known) >= 256:
                            known.clear()
                        known[i] = text_shingles(t, size)
                    both.append(known[i])
                x, y = both
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = 100 * common >= percent * (len(x) + len(y) - common)
            yield rows.loc[keep, ["a", "b"]]

    return work


class Join:
    """The state of one run: classes, and the components of the links confirmed so far."""

    def __init__(self, docs: DataFrame, threshold: float, recall: float, shingle: int) -> None:
        self.spark, self.threshold, self.recall, self.shingle = docs.sparkSession, threshold, recall, shingle
        self.scratch = Scratch(self.spark, "neardup")
        small_batches(self.spark, 1024)
        self.rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        # Ids go through Python as text, since pandas makes floats of integers with nulls.
        named = self.rows.withColumn("doc_id", F.col("doc_id").cast("string"))
        sets = named.mapInPandas(sets_of(shingle), "doc_id string, th long, n_shingles long, sid long, sig binary")
        self.sets = self.scratch.keep(sets.withColumn("doc_id", F.col("doc_id").cast("long")))
        # The row of a class: of least doc_id, null last, then of least text hash.
        classes = self.sets.where("sid is not null").groupBy("sid").agg(F.min_by(F.struct("doc_id", "th"), F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("row"), F.min("sig").alias("sig"))
        self.classes = self.scratch.keep(classes.select("sid", F.col("row.doc_id").alias("doc"), F.col("row.th").alias("th"), "sig"))
        self.n = self.classes.count()
        self.labels: DataFrame | None = None

    def least(self) -> int:
        """Bytes in which the sketches of a pair at the threshold agree, less 5 standard deviations."""
        slack = 5 * math.sqrt(self.threshold * (1 - self.threshold) / SKETCH)
        return math.floor((self.threshold - slack) * SKETCH)

    def run(self) -> None:
        scratch = self.scratch
        depth = depth_of(self.classes, self.n)
        trees = max(1, math.ceil(math.log(1 - self.recall) / math.log(misses(depth, self.threshold))))
        nodes = scratch.keep(self.classes.select("sid", "sig").mapInPandas(grown(trees, depth, EXTRA), "node long, sid long"))
        # Written, as other small sides of joins at keys that may be hot: AQE splits a join only between plain exchanges.
        sizes = scratch.keep(nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"))
        sketches = self.classes.select("sid", "sig").mapInPandas(low_bytes, "sid long, sketch binary")
        members = scratch.keep(nodes.join(sizes, "node").join(sketches, "sid"))
        scratch.drop(nodes, sizes)
        scratch.free_shuffles()
        self.stars(members)
        self.across(members)
        scratch.drop(members)

    def stars(self, members: DataFrame) -> None:
        """Confirms the most promising pair of each class."""
        block = F.pmod(F.xxhash64("sid", "node"), F.ceil(F.col("n") / SIDE)).cast("int")
        dealt = members.select("node", block.alias("block"), "sid", "sketch").repartition("node", "block").sortWithinPartitions("node", "block")
        sure = math.floor((self.threshold + 0.06) * SKETCH)
        best = dealt.mapInPandas(best_pairs(self.least(), sure), "v long, w long, same int")
        top = best.groupBy("v").agg(F.min_by("w", F.struct(-F.col("same"), F.col("w"))).alias("w"))
        best = self.scratch.keep(top.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct())
        links = self.whole(best, self.texts(best.select("a").unionAll(best.select("b"))))
        self.scratch.drop(best)
        self.add(links)

    def across(self, members: DataFrame) -> None:
        """Compares what is left: pairs across the components of a node."""
        scratch = self.scratch
        own = self.labelled(members)
        parts = own.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        left = scratch.keep(parts.select("node"))
        own = scratch.keep(own.join(left, "node"))
        scratch.drop(left)
        small = own.where(F.col("n") <= SIDE).select("node", "sid", "label", "sketch").repartition("node").sortWithinPartitions("node")
        found = scratch.keep(small.mapInPandas(open_pairs(self.least()), "a long, b long, sid long"))
        pairs = scratch.keep(found.where("a is not null").select("a", "b").distinct())
        close = scratch.keep(own.where(F.col("n") > SIDE).select("sid").unionAll(found.where("a is null").select("sid")).distinct())
        scratch.drop(own, found)
        scratch.free_shuffles()
        texts = self.texts(pairs.select("a").unionAll(pairs.select("b")).unionAll(close))
        self.add(self.whole(pairs, texts))
        scratch.drop(pairs)
        self.closest(close, texts)
        scratch.drop(close, texts)

    def closest(self, close: DataFrame, texts: DataFrame) -> None:
        """Joins classes exactly by their rarest shingles: first the most promising pair of each, then what is left."""
        if close.isEmpty():
            return
        scratch, percent = self.scratch, round(100 * self.threshold)
        own = close.join(texts, "sid")
        counts = own.select("text").mapInPandas(slot_counts(self.shingle), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
        frequent = np.zeros(SLOTS, dtype=np.int64)
        counts = counts.toArrow()
        frequent[counts["slot"].to_numpy()] = counts["n"].to_numpy()
        shared = self.spark.sparkContext.broadcast(frequent)
        rows = self.labelled(own).mapInPandas(rarest(shared, percent, self.shingle), "token long, sid long, label long, n long, place long, head boolean")
        rows = scratch.keep(rows)
        per = rows.groupBy("token", "label").agg(F.count("*").alias("k"), F.max("head").alias("head"), F.sum("place").alias("place"), F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("own"))
        left = per.groupBy("token").agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.max("k").alias("k"), F.sum("k").alias("all"), F.count("*").alias("parts"), F.max("head").alias("head"), F.sum("place").alias("place"), F.sum("own").alias("own"))
        # Of tokens that the same sets hold, the rarest has the least places in all of them, and meets whatever the others do.
        left = left.where((F.col("parts") > 1) & F.col("head")).groupBy("own", "all").agg(F.min_by(F.struct("token", "most", "k"), F.struct("place", "token")).alias("t"))
        left = scratch.keep(left.select("t.token", "t.most", "t.k", "all"))
        # Blocks of members outside the largest component come first, and it has blocks of its own, unless one block holds all.
        few = F.col("all") <= SIDE
        odd = F.when(few, 1).otherwise(F.ceil((F.col("all") - F.col("k")) / SIDE)).cast("int")
        even = F.when(few, 0).otherwise(F.ceil(F.col("k") / SIDE)).cast("int")
        salt = F.xxhash64("sid", "token")
        # The rarer tokens of a set that many sets hold, so that sets with much in common meet once, not at each token.
        live = scratch.keep(rows.join(left, "token"))
        many = live.where(F.col("all") > MANY).groupBy("sid").agg(F.slice(F.sort_array(F.collect_list(F.struct("place", "token"))), 1, BEFORE).alias("list"))
        before = F.transform(F.filter("list", lambda x: x["place"] < F.col("place")), lambda x: x["token"])
        dealt = live.join(many, "sid", "left").withColumn("before", F.coalesce(before, F.array().cast("array<long>"))).withColumns({"odd": odd, "even": even, "inside": ~few & (F.col("label") == F.col("most"))})
        dealt = dealt.withColumn("block", F.when(F.col("inside"), F.col("odd") + F.pmod(salt, F.col("even"))).otherwise(F.pmod(salt, F.col("odd"))).cast("int"))
        others = F.sequence(F.lit(0), F.when(F.col("inside"), F.col("odd")).otherwise(F.col("odd") + F.col("even")) - 1)
        dealt = dealt.withColumn("other", F.explode(others)).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        key = ["token", "lo", "hi"]
        dealt = dealt.select(*key, "sid", "label", "n", "place", "head", "block", "before").repartition(*key).sortWithinPartitions(*key)
        met = scratch.keep(dealt.mapInPandas(meeting(percent), "a long, b long").distinct())
        scratch.drop(rows, left, live)
        sketches = self.classes.select("sid", "sig").join(close, "sid", "left_semi").mapInPandas(low_bytes, "sid long, sketch binary")
        side = lambda v, c: sketches.select(F.col("sid").alias(v), F.col("sketch").alias(c))
        passed = scratch.keep(met.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInPandas(sketched(self.least()), "a long, b long, same int"))
        scratch.drop(met)
        scratch.free_shuffles()
        either = passed.select(F.col("a").alias("v"), "a", "b", "same").unionAll(passed.select(F.col("b").alias("v"), "a", "b", "same"))
        best = either.groupBy("v").agg(F.max_by(F.struct("a", "b"), F.struct("same", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        self.add(self.whole(best, texts))
        ends = self.labelled(passed.withColumnRenamed("a", "sid")).select(F.col("sid").alias("a"), "b", F.col("label").alias("la"))
        ends = self.labelled(ends.withColumnRenamed("b", "sid")).where("label <> la").select("a", F.col("sid").alias("b"))
        self.add(self.whole(ends, texts))
        scratch.drop(passed)

    def labelled(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the component of each class, as ``label``."""
        if self.labels is None:
            return rows.withColumn("label", F.col("sid"))
        return rows.join(self.labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))

    def texts(self, ids: DataFrame) -> DataFrame:
        """The written texts of classes: (sid, text)."""
        wanted = self.classes.join(ids.toDF("sid").distinct(), "sid", "left_semi").select("sid", "doc", F.col("th").alias("own"))
        rows = self.rows.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(b""))))
        rows = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("th") == F.col("own"))).select("sid", "text")
        return self.scratch.keep(rows.mapInPandas(own_text(self.shingle), "sid long, text binary").groupBy("sid").agg(F.min("text").alias("text")))

    def whole(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Written links: the pairs whose whole sets hold."""
        both = pairs.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("sid").alias("b"), F.col("text").alias("tb")), "b")
        return self.scratch.keep(both.mapInPandas(confirmed(round(100 * self.threshold), self.shingle), "a long, b long"))

    def add(self, links: DataFrame) -> None:
        """Components of the links so far and ``links``; a component is named by its least class."""
        if self.labels is not None and links.isEmpty():
            return
        known = links if self.labels is None else links.unionAll(self.labels.select("sid", "label"))
        self.labels = self.scratch.keep(components(known).select(F.col("node").alias("sid"), F.col("component").alias("label")))
        self.scratch.free_shuffles()


def own_text(size: int):
    """Rows whose text has the set that is asked for."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            keep = [t is not None and set_id(text_shingles(t, size)) == s for s, t in zip(rows["sid"], rows["text"], strict=True)]
            yield rows.loc[keep, ["sid", "text"]]

    return work


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, a whole number, and text; others are left out).

    Texts without words are linked with nothing: component_id is their own doc_id. Equal sets are linked. Rows of one
    doc_id are judged by their own texts. kept: doc_id is the component's least. A null doc_id is never a component's id
    unless all are null. ``recall`` is the chance that a pair of just the threshold's similarity becomes a candidate.
    ``shingle`` is the number of words of a shingle.
    """
    out = judged(docs, threshold, recall, shingle)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def judged(docs: DataFrame, threshold: float, recall: float, shingle: int) -> DataFrame:
    """doc_id, th, n_shingles, sid, label, component_id for each row; label names the component, null for an empty set."""
    join = Join(docs, threshold, recall, shingle)
    join.run()
    keep = join.scratch.keep
    # A class without links is its own component, so only linked ones meet at a label; a set or component may have many rows.
    linked = join.classes.select("sid", "doc").join(join.labels, "sid")
    least = keep(linked.groupBy("label").agg(F.min("doc").alias("least")))
    known = keep(join.labels.join(least, "label"))
    classes = join.classes.select("sid", "doc").join(known, "sid", "left")
    classes = keep(classes.select("sid", F.coalesce("label", "sid").alias("label"), F.when(F.col("label").isNull(), F.col("doc")).otherwise(F.col("least")).alias("component_id")))
    out = join.sets.select("doc_id", "th", "n_shingles", "sid").join(classes, "sid", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)


def stage_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str, shingle: int = SHINGLE) -> DataFrame:
    """Pipeline stage: one row of each group of near duplicates stays, that of the least doc_id (null last), then of the least
    text hash; of rows that repeat both, one. Texts without words all stay."""
    rows = judged(docs.select("doc_id", "text"), THRESHOLD, RECALL, shingle)
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("th").alias("_th")]
    first = rows.where("label is not null").groupBy("label").agg(F.min_by(F.struct("doc_id", "th"), F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("row"))
    kept = first.select("row.doc_id", "row.th").select(*key, F.lit(True).alias("_one")).distinct()
    kept = kept.unionAll(rows.where("label is null").select(*key, F.lit(False).alias("_one")).distinct())
    own = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), "_th": F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))})
    turn = F.row_number().over(Window.partitionBy("_id", "_th").orderBy(F.xxhash64(*docs.columns)))
    return own.join(kept, ["_id", "_th"]).withColumn("_turn", turn).where("_turn = 1 or not _one").select(*docs.columns)
