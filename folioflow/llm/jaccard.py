"""N-gram Jaccard join over size-banded tiles with hashed bitmap signatures.

1. Each text becomes a sorted array of shingle hashes.  Equal sets are one node.
2. Nodes of similar size meet in a tile of sizes, whose scheme deals hashes into more parts
   than two linked sets of the tile can differ in.  A part and what it holds are a key.
   Linked sets differ in at most so many parts; so of each node's keys, the fullest parts
   first, one more than its worst partner can spoil suffices: the first key that two linked
   sets share stands among those of both.  Full parts are seldom shared by chance.
3. Candidates first pass a bound: the bits in which two parity bitmaps differ are at most
   the elements in which the sets differ, so they bound the overlap from above.  What is
   left is intersected exactly.
4. Each node is compared with one leader, then one of another component; so large groups of
   copies mostly become one component in time that is linear in the group.  What shares a
   key but no component is compared pair by pair in blocks: first the bitmaps alone, which
   tell which nodes have a possible partner, then the sets of those, in which pairs that a
   link has joined meanwhile are skipped.  Each block returns a forest of links, not its
   pairs.  No link between components is lost.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append_columns, text_bytes
from .hashing import LOWER, ODD, mix, word_hashes
from .scratch import Scratch
from .text import word_bounds

#: Bits of a signature.
BITS = 1024
#: Most nodes of one block when nodes are compared pair by pair.
BLOCK = 512
#: Rows and bytes that a task gathers before it works on their groups; groups of so few rows are worked on side by side,
#: so many pairs at once.
GATHER, GATHER_BYTES, FEW, PAIRS = 8192, 8 << 20, 48, 1 << 15


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: A-Z lower-cased, words split at ASCII white space.

    A text of fewer words is one shingle; a text without words, or null, has none.
    """
    raw, offsets = text_bytes(column)
    raw = LOWER[raw]
    starts, ends = word_bounds(raw, offsets)
    words = word_hashes(raw, starts, ends)
    first = np.searchsorted(starts, offsets)
    n = np.diff(first)
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        rolled += words[k : k + len(rolled)] * ODD[k]
    rolled = mix(rolled, 1)
    out = []
    for at, m in zip(first.tolist(), n.tolist(), strict=False):
        if m >= size:
            out.append(np.unique(rolled[at : at + m - size + 1]))
        elif m:
            out.append(mix((words[at : at + m] * ODD[:m]).sum(dtype=np.uint64, keepdims=True), 100 + m))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Tiles:
    """Size bands and the parts of each, for sets whose Jaccard similarity is num / den or more."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            low = self.lows[-1]
            self.lows.append(max(low + 1, -(-low * den**3 // num**3)))

    def most_different(self, a: int, b: int) -> int:
        """Elements in which linked sets of these sizes can differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def tiles(self, n: int) -> list[tuple[int, int, int]]:
        """(tile, parts, spoilt): where a set of n elements meets partners, and how many parts the worst spoils."""
        b = bisect.bisect_right(self.lows, n) - 1
        partner = n * self.den // self.num
        out = []
        for t in (b, b + 1):
            low, high = self.lows[t], self.lows[t + 1] - 1
            if partner >= low:
                most = self.most_different(high, high)
                out.append((t, most + 1 + most // 3, self.most_different(n, min(high, partner))))
        return out

    def keys(self, s: np.ndarray) -> np.ndarray:
        if not len(s):
            return np.zeros(0, np.uint64)
        out, place, value = [], mix(s, 3), mix(s, 4)
        for tile, parts, spoilt in self.tiles(len(s)):
            part = (place % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            fill = np.bincount(part, minlength=parts)
            filled = np.flatnonzero(fill)
            sums = np.zeros(parts, np.uint64)
            sums[filled] = np.add.reduceat(value[order], np.cumsum(fill[filled]) - fill[filled])
            key = mix(sums + np.arange(parts, dtype=np.uint64) * ODD[5] + np.uint64(tile * int(ODD[6]) & (1 << 64) - 1), 5)
            out.append(key[np.lexsort((key, -fill))[: spoilt + 1]])
        return np.concatenate(out)


def signature(s: np.ndarray) -> bytes:
    """Parity of the elements that fall on each bit."""
    return np.packbits(np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def _long(s: np.ndarray) -> np.ndarray:
    return s.view(np.int64)


DIGEST = [T.StructField("n", T.LongType(), False), T.StructField("hi", T.LongType(), False), T.StructField("lo", T.LongType(), False)]
SKETCH = [*DIGEST, T.StructField("bits", T.BinaryType(), False), T.StructField("keys", T.ArrayType(T.LongType(), False), False)]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.append(0, np.cumsum([len(a) for a in arrays])).astype(np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(_long(flat)))


def _digests(sets: list[np.ndarray]) -> list:
    """Sizes, and 128 bits that tell sets apart."""
    pairs = [[int(_long(mix(s, k).sum(dtype=np.uint64, keepdims=True) * ODD[k - 6])[0]) for s in sets] for k in (6, 7)]
    return [[len(s) for s in sets], *pairs]


def sketch(df: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(id, text) to (id, n, hi, lo, bits, keys)."""
    tiles = Tiles(num, den)

    def make(batch: pa.RecordBatch) -> list:
        sets = shingle_sets(batch.column("text"), size)
        return [*_digests(sets), [signature(s) for s in sets], _lists([tiles.keys(s) for s in sets])]

    return append_columns(df, make, SKETCH, "text", ("text",))


def exact_sets(df: DataFrame, size: int) -> DataFrame:
    """(text) to (n, hi, lo, items)."""

    def make(batch: pa.RecordBatch) -> list:
        sets = shingle_sets(batch.column("text"), size)
        return [*_digests(sets), _lists(sets)]

    return append_columns(df.select("text"), make, [*DIGEST, T.StructField("items", T.ArrayType(T.LongType(), False), False)], "text", ("text",))


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp): the smallest node that links (a, b) reach, for every node that has one.

    Labels pass along links, to a node and to the node that is its label, and then jump to the
    label of their label, until none changes.
    """
    edges = scratch.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.save(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")).withColumn("was", F.col("node")), f"{name}-0")
    step = 0
    while not labels.filter("comp != was").isEmpty():
        step += 1
        told = edges.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("near")), "b").join(labels.select(F.col("node").alias("a"), F.col("comp").alias("top")), "a")
        near = told.select(F.explode(F.array("a", "top")).alias("node"), "near").groupBy("node").agg(F.min("near").alias("near"))
        better = labels.join(near, "node", "left").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        better = scratch.save(better, f"{name}-{step}a")
        up = better.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        labels = scratch.save(better.join(up, "comp").select("node", F.least("comp", "top").alias("comp"), "was"), f"{name}-{step}")
        scratch.drop(f"{name}-{step}a", f"{name}-{step - 1}")
    scratch.drop(f"{name}-edges")
    return labels.select("node", "comp")


def _alike(num: int, den: int, common: Column) -> Column:
    return common * (num + den) >= (F.col("na") + F.col("nb")) * num


def _bit_bound(df: DataFrame, num: int, den: int) -> DataFrame:
    """Keep pairs whose bitmaps leave the needed overlap possible."""

    def run(batches):
        for b in batches:
            x, y = (_bitmaps(b.column(c)) for c in ("bits_a", "bits_b"))
            na, nb = (b.column(c).to_numpy() for c in ("na", "nb"))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            keep = pa.array((na + nb - apart) * (num + den) >= 2 * num * (na + nb))
            yield b.select(["a", "b"]).filter(keep)

    return df.mapInArrow(run, "a long, b long")


def _bitmaps(column: pa.Array) -> np.ndarray:
    return text_bytes(column)[0].copy().view(np.uint64).reshape(-1, BITS // 64)


def grouped(df: DataFrame, keys: list[str], work: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Give ``work`` batches of whole groups and where groups begin (one more than groups)."""

    def cut(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, np.ndarray, pa.Table]:
        batch = table.combine_chunks().to_batches()[0]
        edge = np.zeros(batch.num_rows, bool)
        edge[0] = True
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            edge[1:] |= v[1:] != v[:-1]
        begin = np.append(np.flatnonzero(edge), batch.num_rows)
        if not last:
            begin = begin[:-1]
        return batch.slice(0, int(begin[-1])), begin, table.slice(int(begin[-1]))

    def run(batches):
        held, rows, size = [], 0, 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows, size = rows + b.num_rows, size + b.nbytes
                if rows >= GATHER or size > GATHER_BYTES:
                    batch, begin, rest = cut(pa.Table.from_batches(held), False)
                    if len(begin) > 1:
                        yield from work(batch, begin)
                    held, rows, size = rest.to_batches(), rest.num_rows, rest.nbytes
        if held:
            batch, begin, _ = cut(pa.Table.from_batches(held), True)
            yield from work(batch, begin)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _pairs_within(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of each group."""
    size = np.diff(begin)
    after = np.repeat(begin[1:], size) - np.arange(begin[0], begin[-1]) - 1
    x = np.repeat(np.arange(begin[0], begin[-1]), after)
    return x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(after) - after, after)


def _possible(bits: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of two blocks the bitmaps allow, by one matrix product."""
    x, y = (np.unpackbits(bits[i].view(np.uint8), axis=1).astype(np.float32) for i in (left, right))
    both = (x @ y.T).astype(np.int64)
    apart = x.sum(axis=1).astype(np.int64)[:, None] + y.sum(axis=1).astype(np.int64)[None, :] - 2 * both
    total = n[left][:, None] + n[right][None, :]
    return (total - apart) * (num + den) >= 2 * num * total


def _sides(batch: pa.RecordBatch, a: int, b: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of a tile's two blocks, and whether they are one."""
    i, j = batch.column("i")[a].as_py(), batch.column("j")[a].as_py()
    block = batch.column("block").to_numpy()[a:b]
    return a + np.flatnonzero(block == i), a + np.flatnonzero(block == j), i == j


TILE = ["kind", "id", "i", "j"]


def _flagged(num: int, den: int):
    """The rows of each tile that have a possible partner in another component."""

    def work(batch: pa.RecordBatch, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
        bits = _bitmaps(batch.column("bits"))
        comp, n, block, i, j = (batch.column(c).to_numpy() for c in ("comp", "n", "block", "i", "j"))
        flag = np.zeros(batch.num_rows, bool)
        small = np.diff(begin) <= FEW
        for a, b in zip(begin[:-1][~small].tolist(), begin[1:][~small].tolist(), strict=True):
            left, right, one = _sides(batch, a, b)
            good = _possible(bits, n, left, right, num, den) & (comp[left][:, None] != comp[right][None, :])
            flag[left[good.any(axis=1)]] = True
            flag[right[good.any(axis=0)]] = True
        # small groups side by side, in runs of bounded numbers of pairs
        sizes = np.diff(begin)
        run = np.cumsum(sizes * (sizes - 1) // 2 * small) // PAIRS
        for r in np.unique(run[small]).tolist():
            parts = [_pairs_within(begin[k : k + 2]) for k in np.flatnonzero(small & (run == r)).tolist()]
            x, y = (np.concatenate(p) for p in zip(*parts, strict=True))
            fit = (comp[x] != comp[y]) & ((i[x] == j[x]) | (block[x] != block[y]))
            x, y = x[fit], y[fit]
            total, apart = n[x] + n[y], np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            good = (total - apart) * (num + den) >= 2 * num * total
            flag[x[good]] = flag[y[good]] = True
        yield batch.select([*TILE, "node", "comp", "block"]).filter(pa.array(flag))

    return work


def _overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted array with others."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.searchsorted(one, flat)
    hit = one[np.minimum(at, len(one) - 1)] == flat
    return np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)


def _forest(num: int, den: int):
    """Links between components of each tile: a forest that joins what all its links join."""

    def work(batch: pa.RecordBatch, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
        lists = batch.column("items")
        flat, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
        node, comp = batch.column("node").to_numpy(), batch.column("comp").to_numpy()
        sets = [np.sort(flat[a:b]) for a, b in zip(ends, ends[1:])]  # noqa: B905
        n = np.array([len(s) for s in sets], np.int64)
        found: list[tuple[int, int]] = []
        for a, b in zip(begin.tolist(), begin[1:].tolist()):  # noqa: B905
            top = {c: c for c in comp[a:b].tolist()}

            def root(c: int, top=top) -> int:
                while top[c] != c:
                    top[c] = c = top[top[c]]
                return c

            left, right, one = _sides(batch, a, b)
            bits = np.frombuffer(b"".join(signature(s) for s in sets[a:b]), np.uint64).reshape(-1, BITS // 64)
            good = _possible(bits, n[a:b], left - a, right - a, num, den) & (comp[left][:, None] != comp[right][None, :])
            if one:
                good = np.triu(good, 1)
            for k in np.flatnonzero(good.any(axis=1)).tolist():
                x = int(left[k])
                todo = right[good[k]].tolist()
                while todo:
                    some, todo = todo[:32], todo[32:]
                    some = [y for y in some if root(comp[y].item()) != root(comp[x].item())]
                    if some:
                        common = _overlaps(sets[x], [sets[y] for y in some])
                        for y, c in zip(some, common.tolist(), strict=True):
                            if c * (num + den) >= num * int(n[x] + n[y]) and (p := root(comp[x].item())) != (q := root(comp[y].item())):
                                top[max(p, q)] = min(p, q)
                                found.append((int(node[x]), int(node[y])))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return work


def _tiled(opened: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (kind, id, i, j, block, node, comp) of tiles that hold every pair of nodes with a common key and different components.

    Nodes that keys connect are one group where that makes fewer pairs than the keys' own groups:
    near copies share many keys, and their pairs are then looked at once.  Within a group the
    nodes of its largest component are compared with the others only.
    """
    # each key joins the group of the smallest leader that its nodes' keys know, twice over: a pair with a common key stays together
    ids, name = opened.select("key", "node", F.col("lead").alias("id")), ""
    for step in ("ids0", "ids1"):
        least = ids.groupBy("node").agg(F.min("id").alias("least"))
        keyed = scratch.save(ids.join(least, "node").groupBy("key").agg(F.min("least").alias("id")), step)
        ids = opened.select("key", "node").join(keyed, "key")
        scratch.drop(*[name] * bool(name))
        name = step
    rows = opened.join(keyed, "key")
    per_key = opened.filter("node = lead").select("key", "m").join(keyed, "key").groupBy("id").agg(F.sum(F.col("m") * F.col("m")).alias("by_key"))
    once = scratch.save(rows.select("id", "node", "comp").distinct(), "once")
    per_group = once.groupBy("id").agg(F.count(F.lit(1)).alias("m"))
    whole = scratch.save(per_group.join(per_key, "id").filter(F.col("m") * F.col("m") <= F.col("by_key")).select("id"), "whole")
    together = once.join(whole, "id").select(F.lit(0).alias("kind"), "id", "node", "comp")
    apart = rows.join(whole, "id", "left_anti").select(F.lit(1).alias("kind"), F.col("key").alias("id"), "node", "comp")
    rows = scratch.save(together.unionByName(apart), "grouped")
    scratch.drop(name, "once", "whole")
    sizes = rows.groupBy("kind", "id", "comp").agg(F.count(F.lit(1)).alias("m"))
    main = sizes.groupBy("kind", "id").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.max("m").alias("mains"), F.sum("m").alias("all"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    main = scratch.save(main.filter(F.col("all") > F.col("mains")).select("kind", "id", "main", blocks(F.col("mains")).alias("bm"), blocks(F.col("all") - F.col("mains")).alias("bs")), "mains")
    rows = rows.join(main, ["kind", "id"])
    inside = F.col("comp") == F.col("main")
    h = F.xxhash64("node")
    rows = rows.withColumn("block", F.when(inside, F.col("bs") + F.pmod(h, F.col("bm"))).otherwise(F.pmod(h, F.col("bs"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("bs") - 1 + F.when(inside, F.lit(0)).otherwise(F.col("bm")))))
    return rows.select("kind", "id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp")


class Join:
    """The join of one table: ``rows`` (id, n, hi, lo), ``nodes`` (hi, lo, id, node) and ``comps`` (node, comp) of linked nodes."""

    def __init__(self, docs: DataFrame, size: int, num: int, den: int, id_col: str, text_col: str):
        self.scratch = scratch = Scratch(docs.sparkSession, "jaccard")
        self.size, self.num, self.den = size, num, den
        picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        sketched = scratch.save(sketch(picked, size, num, den), "sketch")
        self.rows = scratch.save(sketched.select("id", "n", "hi", "lo"), "rows")
        one = sketched.filter("n > 0").groupBy("hi", "lo", "n").agg(F.min("id").alias("id"), F.any_value("bits").alias("bits"), F.any_value("keys").alias("keys"))
        noded = scratch.save(one.withColumn("node", F.monotonically_increasing_id()), "noded")
        scratch.drop("sketch")
        self.nodes = scratch.save(noded.select("hi", "lo", "id", "node"), "nodes")
        self.comps = self._link(noded, picked)
        scratch.drop("members", "bits", "sets")

    def _link(self, noded: DataFrame, picked: DataFrame) -> DataFrame:
        scratch = self.scratch
        keyed = noded.select("node", F.explode("keys").alias("key"))
        shared = scratch.save(keyed.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader < last").select("key", "leader"), "shared")
        members = scratch.save(keyed.join(shared, "key"), "members")
        scratch.drop("shared")
        firsts = members.groupBy("node").agg(F.min("leader").alias("leader"))
        comps = scratch.save(firsts.select("node", F.col("node").alias("comp")), "comps0")
        self.bits = scratch.save(noded.join(comps, "node", "left_semi").select("node", "n", "bits"), "bits")
        first_pairs = scratch.save(firsts.filter("leader != node").select(F.col("leader").alias("a"), F.col("node").alias("b")), "pairs0")
        scratch.drop("noded")
        self._read_sets(picked, comps)
        comps = self._merge(comps, self._verify(first_pairs, "star0"), "comps1", "comps0", "pairs0")
        # a second leader, of another component, for what shares keys across components
        placed = members.select("key", "node").join(comps, "node")
        placed = scratch.save(placed, "placed")
        ends = placed.groupBy("key").agg(F.min(F.struct("comp", "node")).alias("low"), F.max(F.struct("comp", "node")).alias("high")).filter("low.comp < high.comp")
        other = F.when(F.col("comp") == F.col("low.comp"), F.col("high.node")).otherwise(F.col("low.node"))
        pairs = placed.join(ends, "key").groupBy("node").agg(F.min(other).alias("other"))
        pairs = scratch.save(pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "pairs1")
        scratch.drop("placed")
        comps = self._merge(comps, self._verify(pairs, "star1"), "comps2", "comps1", "pairs1")
        # keys that still hold several components: pair by pair in blocks
        placed = scratch.save(members.select("key", "node").join(comps, "node"), "placed")
        sizes = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("node").alias("lead"), F.count(F.lit(1)).alias("m")).filter("c0 < c1")
        opened = scratch.save(placed.join(sizes.select("key", "lead", "m"), "key"), "opened")
        scratch.drop("placed", "members")
        tiles = _tiled(opened, scratch).join(self.bits, "node").select(*TILE, "block", "node", "comp", "n", "bits")
        flagged = scratch.save(grouped(tiles, TILE, _flagged(self.num, self.den), "kind int, id long, i int, j int, node long, comp long, block int"), "flagged")
        scratch.drop("opened", "grouped", "mains", "bits")
        links = scratch.save(grouped(flagged.join(self.sets, "node"), TILE, _forest(self.num, self.den), "a long, b long"), "forest")
        scratch.drop("flagged", "sets")
        return self._merge(comps, links, "comps3", "comps2", "forest")

    def _read_sets(self, picked: DataFrame, active: DataFrame) -> None:
        """``sets`` (node, items) of the active nodes, read from the texts of their smallest ids."""
        wanted = self.nodes.join(active, "node", "left_semi")
        texts = picked.join(wanted.select("id").distinct(), "id", "left_semi")
        if not wanted.filter("id is null").isEmpty():
            texts = texts.unionByName(picked.filter("id is null"))
        once = exact_sets(texts, self.size).groupBy("hi", "lo", "n").agg(F.any_value("items").alias("items"))
        self.sets = self.scratch.save(once.join(wanted.select("hi", "lo", "node"), ["hi", "lo"]).select("node", "items"), "sets")

    def _verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """Links among candidate pairs (a, b), of which a node has few."""
        side = lambda t, c, cols: t.select(F.col("node").alias(c), *(F.col(x).alias(y) for x, y in cols.items()))
        with_bits = pairs.join(side(self.bits, "a", {"n": "na", "bits": "bits_a"}), "a").join(side(self.bits, "b", {"n": "nb", "bits": "bits_b"}), "b")
        left = self.scratch.save(_bit_bound(with_bits.select("a", "b", "na", "nb", "bits_a", "bits_b"), self.num, self.den), f"{name}-bound")
        full = left.join(side(self.sets, "b", {"items": "sb"}), "b").join(side(self.sets, "a", {"items": "sa"}), "a")
        both = full.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"))
        links = self.scratch.save(both.filter(_alike(self.num, self.den, F.col("common"))).select("a", "b"), name)
        self.scratch.drop(f"{name}-bound")
        return links

    def _merge(self, comps: DataFrame, links: DataFrame, name: str, *read: str) -> DataFrame:
        """``comps`` with the components that links join made one; then the tables ``read`` go."""
        of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
        ends = links.join(of("a"), "a").join(of("b"), "b").filter("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        joined = components(ends, self.scratch, f"{name}-parts")
        out = self.scratch.save(comps.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), name)
        self.scratch.drop(*read)
        return out

    def named(self) -> DataFrame:
        """(hi, lo, id, comp): each node's digest, smallest id and component, its own where nothing links it."""
        return self.nodes.join(self.comps, "node", "left").select("hi", "lo", "id", F.coalesce("comp", "node").alias("comp"))


def cluster(docs: DataFrame, size: int = 3, num: int = 9, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles and component_id, the smallest id that links reach.

    Sets link when ``den`` times their intersection is at least ``num`` times their union.
    Null texts and texts without words have no shingles and no links.  Repeated rows are
    linked with each other; rows without an id take part, but give no component their id (a
    component of such rows alone has none).  Columns other than id and text are not read, so
    their names can't clash.  An empty table gives no rows.
    """
    join = Join(docs, size, num, den, id_col, text_col)
    named = join.named()
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    found = named.join(least, "comp").select("hi", "lo", "component_id")
    return join.rows.join(found, ["hi", "lo"], "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )


def jaccard_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, for distinct 3-word shingles and 0.9."""
    return cluster(docs).withColumnRenamed("id", "doc_id")


def keep_one(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id, rows without an id last.

    Decided by row, not by id: of rows that share an id, those of other components stay.  Among
    rows of the kept id that are in the component, the one of the lowest digest of its shingles stays, then of the
    lowest text.  Rows without shingles (null, empty, blank texts) all stay.  Columns may have any names.  An empty table gives no rows.
    """
    join = Join(docs, size, num, den, id_col, text_col)
    best = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "hi", "lo")).alias("best")
    rows = join.rows.filter("n > 0")
    placed = rows.select("id", "hi", "lo").join(join.named().select("hi", "lo", "comp"), ["hi", "lo"])
    keepers = join.scratch.save(placed.groupBy("comp").agg(best).select("best.id", "best.hi", "best.lo"), "keepers")
    # an id of one row is decided by itself; rows of other ids by their shingles too
    ids = join.rows.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"))
    several = join.scratch.save(ids.filter("rows > 1").select("id"), "several")
    gone = join.scratch.save(ids.filter("n > 0").join(keepers, "id", "left_anti").select("id").union(several).distinct(), "gone")
    taken = {c.lower() for c in docs.columns}
    own = lambda name: next(n for n in (f"{name}{i}" for i in range(len(taken) + 1)) if n.lower() not in taken)
    key, row = own("_id"), own("_row")
    by_id = docs.filter(F.col(id_col).isNotNull()).join(gone.select(F.col("id").alias(key)), F.col(id_col) == F.col(key), "left_anti")
    doubtful = docs.join(several.select(F.col("id").alias(key)), F.col(id_col) == F.col(key), "left_semi").unionByName(docs.filter(F.col(id_col).isNull()))
    tagged = digested(doubtful.select(F.struct(*docs.columns).alias(row), F.col(id_col).alias("id"), F.col(text_col).alias("text")), size)
    blank = tagged.filter("n = 0").select(f"{row}.*")
    same = [tagged["hi"] == keepers["hi"], tagged["lo"] == keepers["lo"], tagged["id"].eqNullSafe(keepers["id"])]
    once = tagged.filter("n > 0").join(keepers, same, "left_semi").groupBy("id", "hi", "lo").agg(F.min_by(row, "text").alias(row))
    return by_id.unionByName(blank).unionByName(once.select(f"{row}.*"))


def digested(df: DataFrame, size: int) -> DataFrame:
    """Add n, hi and lo of the text's shingles."""
    return append_columns(df, lambda b: _digests(shingle_sets(b.column("text"), size)), DIGEST)
