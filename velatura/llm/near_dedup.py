"""SimHash near-duplicates, linked through a Gray-order hierarchical index of the fingerprints.

Upper nodes of the index factor bits that their members share. At the top stand d + 1 disjoint sets of the 64 bits, for links of at most d
differing bits: two such fingerprints agree in one of the sets, so a node is a set with its bits, and each fingerprint stands in d + 1
nodes. A node with too many members is divided in the same way over the bits it has left, at most twice. Nodes are dealt over the
cluster; a task sorts all fingerprints of its nodes by node and Gray rank and builds one tree over them. A tree's node holds the
mask of the bits that its members share and their pattern; going down, a pair of nodes adds the differences in the bits that
both fix and their parents did not, and is pruned as a whole once they are more than d, or once no upper node has members in both.
What a task sends on is a spanning forest of its links, so that no group's pairs are ever listed.

Where the shared part of the shingles themselves is asked for, similar_documents takes the links of the same index as candidates and confirms
each by the whole sets. Its fingerprints are of the set of a text's single words, which a changed word moves by few bits, where it changes
five shingles of five words. Bits only estimate similarity, and no limit of bits holds all pairs of a given similarity, so what
the index leaves apart is completed by the sets: two of similarity t share one of their first n - ceil(t n) + 1 shingles in any common
order, so they meet in a list of such a shingle, and each pair found there that isn't connected yet is compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from velatura.llm.common import attach, blobs, cut, prepare, rows, sliced, tidy

BITS = 64
#: Members from which an upper node is divided, rows from which a task builds a tree, and members of a tree's leaf.
NODE_MEMBERS = 1 << 14
TREE_ROWS = 1 << 15
LEAF = 32
#: Group pairs of a tree that are looked at together.
FRONTIER = 1 << 14
_CHUNK = 1 << 15
#: Members from which a shingle's list is linked by a star first, documents in the sample that orders shingles, shingles it names.
LIST_MEMBERS = 64
SAMPLE_DOCS = 20_000
COMMON = 1 << 18
#: Differing bits up to which the index links fingerprints of word sets.
INDEX_LIMIT = 5
#: Ids whose texts are read again that are broadcast; beyond them: a join.
BROADCAST_IDS = 1 << 20


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of each word shingle of a text, in order, repeats included; a text of fewer words is one shingle."""
    found = text.lower().split()
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, seed)] if found else [], np.uint64)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    spans = zip((end - size)[: len(found) - words + 1].tolist(), end[words - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(found) - words + 1)


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of a whole text's word shingles, repeats included, under XXH64."""
    return _simhash(shingle_hashes(text, words, seed))


def word_fingerprint(text: bytes, seed: int = 42) -> int:
    """SimHash of the set of a whole text's words under XXH64."""
    found = set(text.lower().split())
    return _simhash(np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in found), np.uint64, len(found)))


def _simhash(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8), bitorder="little").reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int, seed: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            found = np.array([fingerprint(t, words, seed) for t in blobs(batch, 1)], np.uint64)
            yield rows(schema, batch.column(0), found.view(np.int64))

    return run, "doc_id long, fp long"


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each number in the Gray code sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class Forest:
    """Union-find over the numbers below n; a root is the smallest of its tree."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class GrayTree:
    """The index of fingerprints that are sorted by upper node and Gray rank: leaves of LEAF members, two children a node."""

    def __init__(self, values: np.ndarray, upper: np.ndarray):
        n = len(values)
        leaves = 1 << max(0, (-(-n // LEAF) - 1).bit_length())
        self.n, self.values = n, np.append(values, np.repeat(values[-1:], leaves * LEAF - n))
        upper = np.append(upper, np.repeat(upper[-1:], leaves * LEAF - n)).reshape(leaves, LEAF)
        some, every = (f.reduce(self.values.reshape(leaves, LEAF), 1) for f in (np.bitwise_or, np.bitwise_and))
        first, last = upper[:, 0], upper[:, -1]
        self.levels = []  # from leaves to the root: mask of shared bits, their pattern, the first and the last upper node
        while True:
            mask = ~(some ^ every)
            self.levels.append((mask, every & mask, first, last))
            if len(some) == 1:
                break
            some, every, first, last = some[::2] | some[1::2], every[::2] & every[1::2], first[::2], last[1::2]

    def link(self, limit: int, forest: Forest) -> None:
        """Link all members of an upper node that differ in at most limit bits; the forest has a number for each member."""
        pending = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))]
        whole = self._uniform(forest)
        while pending:
            level, a, b, differ = pending.pop()
            if len(a) > FRONTIER:
                pending += [(level, a[FRONTIER:], b[FRONTIER:], differ[FRONTIER:]), (level, a[:FRONTIER], b[:FRONTIER], differ[:FRONTIER])]
                continue
            mask, pattern, first, last = self.levels[level]
            fixed = mask[a] & mask[b]
            if level < len(self.levels) - 1:
                above = self.levels[level + 1][0]
                fixed &= ~(above[a >> 1] & above[b >> 1])  # the parents have counted theirs
            differ = differ + _popcount((pattern[a] ^ pattern[b]) & fixed)
            near = (differ <= limit) & (first[b] <= last[a])
            a, b, differ = a[near], b[near], differ[near]
            if level:
                same = a == b
                left, right = 2 * a, 2 * b
                down = [(left, right, differ), (left + 1, right + 1, differ), (left, right + 1, differ), (left[~same] + 1, right[~same], differ[~same])]
                a, b, differ = (np.concatenate(x) for x in zip(*down))
                if level == 1:
                    order = np.argsort(b - a, kind="stable")
                    a, b, differ = a[order], b[order], differ[order]
                pending.append((level - 1, a, b, differ))
                continue
            for i in range(0, len(a), 512):
                x, y = a[i : i + 512], b[i : i + 512]
                open_ = (whole[x] < 0) | (whole[x] != whole[y])
                x, y = x[open_], y[open_]
                p, q = x[:, None] * LEAF + np.arange(LEAF), y[:, None] * LEAF + np.arange(LEAF)
                close = _popcount(self.values[p][:, :, None] ^ self.values[q][:, None, :]) <= limit
                k, u, v = np.nonzero(close)
                u, v = np.minimum(p[k, u], self.n - 1), np.minimum(q[k, v], self.n - 1)
                if (u != v).any():
                    forest.link(u, v)
                    whole = self._uniform(forest)

    def _uniform(self, forest: Forest) -> np.ndarray:
        """The component of each leaf, or -1 if it has several."""
        root = np.append(forest.root, np.repeat(forest.root[-1:], len(self.values) - self.n)).reshape(-1, LEAF)
        return np.where((root == root[:, :1]).all(axis=1), root[:, 0], -1)


def node_links(node: np.ndarray, fp: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each fingerprint with one of its component, over whole upper nodes; all of them enter the tree."""
    order = np.lexsort((gray_rank(fp), node))
    node, fp = node[order], fp[order]
    forest = Forest(len(fp))
    GrayTree(fp, np.cumsum(np.concatenate([[0], node[1:] != node[:-1]]))).link(limit, forest)
    own = np.flatnonzero(forest.root != np.arange(len(fp)))
    return fp[own], fp[forest.root[own]]


def _node_links(limit: int):
    """In: (node, fp), sorted by node. Out: their links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return rows(schema, *(x.view(np.int64) for x in node_links(node, fp, limit)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            node = np.concatenate([node, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            done = int(np.searchsorted(node, node[-1], "left"))  # the last node may go on in the next batch
            if done >= TREE_ROWS:
                yield links(node[:done], fp[:done])
                node, fp = node[done:], fp[done:]
        if len(fp):
            yield links(node, fp)

    return run, "a long, b long"


def _parts(mask: int, n: int) -> list[int]:
    """n disjoint sets of bits that make up the mask."""
    bits = [i for i in range(BITS) if mask >> i & 1]
    cuts = [k * len(bits) // n for k in range(n + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def hamming_links(prints: DataFrame, limit: int = 2, node_members: int = NODE_MEMBERS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) such that those within `limit` bits are connected, and no others."""
    sets = limit + 1
    rows_, found = prints.select("fp", F.lit(0).cast("long").alias("node"), F.lit(0).alias("path")), None
    masks = {0: (1 << BITS) - 1}
    for depth in (1, 2, 3):
        below = {p: [(sets * p + 1 + i, m) for i, m in enumerate(_parts(free, sets))] for p, free in masks.items()}
        child = lambda i: F.element_at(F.create_map(*[F.lit(x) for p, c in below.items() for x in (p, _signed(c[i][1]))]), F.col("path"))  # noqa: B023, E731
        parts = F.array(*[F.struct((F.col("path") * sets + 1 + i).alias("path"), F.col("fp").bitwiseAND(child(i)).alias("value")) for i in range(sets)])
        spread = rows_.select("fp", "node", F.explode(parts).alias("part")).select("fp", F.xxhash64("node", "part.path", "part.value").alias("node"), "part.path")
        sizes = spread.groupBy("node").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > 1)
        sized = cut(spread.join(sizes, "node"))
        last = depth == 3
        ready = sized if last else sized.filter(F.col("members") <= node_members)
        linked = ready.select("node", "fp").repartition("node").sortWithinPartitions("node").mapInArrow(*_node_links(limit))
        found = linked if found is None else found.unionByName(linked)
        if last or sized.filter(F.col("members") > node_members).isEmpty():
            break
        rows_ = sized.filter(F.col("members") > node_members).select("fp", "node", "path")
        masks = {p: masks[parent] & ~m for parent, c in below.items() for p, m in c}
    return found.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b), root being the smallest node of its component.

    Alternating large and small stars (Kiveris and others, 2014): every round shortens the paths to the root by a factor, also
    in long chains, each node's smallest neighbour is found by an aggregate, and lineage is cut in every round.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
    before = mark(edges)
    while before.n:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _linked(docs: DataFrame, words: int, limit: int, seed: int, id_col: str, text_col: str, node_members: int) -> DataFrame:
    """doc_id, fp, root (equal in a component) and component_id of each row."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    marked = cut(source.mapInArrow(*_fingerprints(words, seed)))
    prints = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("n")))
    roots = components(hamming_links(prints, limit, node_members))
    rooted = cut(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "smallest", "n", F.coalesce("root", "fp").alias("root")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("smallest").alias("component_id")), "root").select("fp", "root", "component_id", "n")
    total = marked.count()
    return attach(marked, cut(named), "fp", "n", total, "inner").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, limit: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", node_members: int = NODE_MEMBERS) -> DataFrame:
    """For each document: doc_id, fp (the fingerprint as a signed number) and component_id (the smallest doc_id reachable over
    links of at most `limit` differing bits, itself included).

    Defined results: a text without words, or null, has fingerprint 0 and is linked like any other; a text of fewer words than a
    shingle is one shingle; repeated rows each get a row; null ids are never the smallest, and a component of null ids only has none;
    other columns are not looked at; an empty table gives no rows.
    """
    return _linked(docs, words, limit, seed, id_col, text_col, node_members).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3, limit: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, unchanged, of each component of near_duplicates: that of the smallest id, null being the largest, and of
    equal ids that of the smallest fingerprint; rows equal in both are one. Columns of any name pass through."""
    found = _linked(docs, words, limit, seed, id_col, text_col, NODE_MEMBERS)
    return _one_row_each(docs, found, _fingerprints(words, seed)[0], id_col, text_col)


def _set_digest(found: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(found.tobytes()))


def _parity(found: np.ndarray) -> np.ndarray:
    """Two to four bits for each shingle, each the parity of those that fall on it: two sets differ in at least as many shingles
    as these in bits. The number of bits is a power of two, so that the exclusive or of both halves is that of half as many."""
    width = 1 << max(6, (2 * len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *[v.view(np.int64) for v in values]])))


_LONGS = pa.list_(pa.int64())


def _set_marks(words: int, seed: int, level: Fraction, common):
    """In: id, text. Out: id, the set's digest (fp), the SimHash of its words (sim), its size and parity bits, and its first shingles,
    rare ones before common ones. Equal sets of shingles hold equal words, so sim depends on fp alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("sim", pa.int64()), ("n", pa.int64()), ("bits", _LONGS), ("prefix", _LONGS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = common.value
        for batch in sliced(batches, 1):
            texts = blobs(batch, 1)
            sets, prefixes = [np.unique(shingle_hashes(t, words, seed)) for t in texts], []
            sims = [_signed(word_fingerprint(t, seed)) for t in texts]
            for found in sets:
                size = len(found) + int(len(found) * -level // 1) + 1 if len(found) else 0
                if len(names):
                    at = np.minimum(np.searchsorted(names, found), len(names) - 1)
                    found = found[np.argsort(np.where(names[at] == found, counts[at], 0), kind="stable")]
                prefixes.append(found[:size])
            yield rows(schema, batch.column(0), [_set_digest(x) for x in sets], sims, list(map(len, sets)), _lists([_parity(x) for x in sets]), _lists(prefixes))

    return run, "doc_id long, fp long, sim long, n long, bits array<long>, prefix array<long>"


def _sets(words: int, seed: int):
    """In: id, text. Out: the digest of each text's set of shingles, and the set."""
    schema = pa.schema([("fp", pa.int64()), ("found", _LONGS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            sets = [np.unique(shingle_hashes(t, words, seed)) for t in blobs(batch, 1)]
            yield rows(schema, [_set_digest(x) for x in sets], _lists(sets))

    return run, "fp long, found array<long>"


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Columns of batches sorted by the first, cut between its values, with the place of each row in its list and the list's size."""

    def ready(own: list[np.ndarray]):
        start = np.flatnonzero(np.concatenate([[True], own[0][1:] != own[0][:-1]]))
        size = np.diff(np.append(start, len(own[0])))
        return own, np.arange(len(own[0])) - np.repeat(start, size), np.repeat(size, size)

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        done = int(np.searchsorted(held[0], held[0][-1], "left"))  # the last list may go on in the next batch
        if done >= 1 << 15:
            yield ready([c[:done] for c in held])
            held = [c[done:] for c in held]
    if held is not None:
        yield ready(held)


def _shared_lists():
    """In: shingle, fp, n, pos, sorted by shingle and fp. Out: each once, with the list's size, of lists with several members."""
    schema = pa.schema([(c, pa.int64()) for c in ("shingle", "fp", "n", "pos", "members")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, rank, _ in _whole_lists(batches):
            new = np.concatenate([[True], own[1][1:] != own[1][:-1]]) | (rank == 0)
            members = np.add.reduceat(new.astype(np.int64), np.flatnonzero(rank == 0))
            size = np.repeat(members, np.diff(np.append(np.flatnonzero(rank == 0), len(rank))))
            keep = new & (size > 1)
            yield rows(schema, *[c[keep] for c in (*own, size)])

    return run, "shingle long, fp long, n long, pos long, members long"


class _Bits:
    """Parity bits of rows, by their number of words, and the fewest shingles that two rows can differ in."""

    def __init__(self, column: pa.Array):
        values, start = column.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
        self.size, self.at, self.of = np.diff(start), np.zeros(len(start) - 1, np.int64), {}
        for w in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == w)
            self.at[own] = np.arange(len(own))
            self.of[w] = values[start[own][:, None] + np.arange(w)]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)  # sizes that are further apart than a factor of two: only the sets tell
        x, y = np.where(self.size[x] <= self.size[y], x, y), np.where(self.size[x] <= self.size[y], y, x)
        for w, few in self.of.items():
            for v in (w, 2 * w):
                own = np.flatnonzero((self.size[x] == w) & (self.size[y] == v))
                for i in range(0, len(own), 4096):
                    k = own[i : i + 4096]
                    more = self.of[v][self.at[y[k]]]
                    out[k] = _popcount(few[self.at[x[k]]] ^ (more if v == w else more[:, :w] ^ more[:, w:])).sum(1, dtype=np.int64)
        return out


def _list_pairs(level: Fraction, star: bool):
    """In: shingle, fp, n, pos, root, bits, sorted by shingle. Out: pairs of a list with different roots that can be similar by their
    sizes, the shingle's places and their bits; with star, only those with one member, that the shingle chooses."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    num, den = level.numerator, level.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shingle, fp, n, pos, root, bits), rank, size in _whole_lists(batches):
            parity = _Bits(pa.array(bits, _LONGS))

            def pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
                most = np.minimum(pos[x], pos[y]) + 1 + np.minimum(n[x] - pos[x], n[y] - pos[y]) - 1
                near = (root[x] != root[y]) & (np.minimum(most, np.minimum(n[x], n[y])) * (num + den) >= num * (n[x] + n[y]))
                x, y = x[near], y[near]
                near = (n[x] + n[y] - parity.apart(x, y)) * (num + den) >= 2 * num * (n[x] + n[y])
                a, b = fp[x[near]], fp[y[near]]
                return rows(schema, np.minimum(a, b), np.maximum(a, b))

            every = np.arange(len(fp))
            if star:
                yield pairs(every - rank + np.mod(shingle, size), every)
                continue
            for shift in range(1, int(size.max())):
                at = np.flatnonzero(size - rank > shift)
                yield pairs(at, at + shift)

    return run, "a long, b long"


def _index_pairs(prints: DataFrame, limit: int) -> DataFrame:
    """Candidates (a, b), a < b, that the index gives for sets (fp) with fingerprints (sim): each set with one of equal fingerprint, and
    one set of each of two fingerprints that the index links."""
    first = cut(prints.groupBy("sim").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("members")))
    equal = attach(prints.select("sim", F.col("fp").alias("b")), first.filter("members > 1"), "sim", "members", prints.count(), "inner").filter("a <> b").select("a", "b")
    of = lambda side, name: first.select(F.col("sim").alias(side), F.col("a").alias(name))
    near = hamming_links(first.select(F.col("sim").alias("fp")), limit).toDF("sim_a", "sim_b").join(of("sim_a", "x"), "sim_a").join(of("sim_b", "y"), "sim_b")
    return equal.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", list_members: int = LIST_MEMBERS, limit: int = INDEX_LIMIT) -> DataFrame:
    """For each document: doc_id, fp (the digest of its set of word shingles) and root (equal for documents connected by links).

    Linked are all pairs whose sets of shingles have a shared part (intersection by union) of the similarity or more, and no others.
    The index gives links of at most `limit` differing bits, each confirmed by the sets; any limit gives the same result, and what it
    leaves apart meets in lists of shingles. These are ordered by their number in a sample of the documents and by hash; any order
    gives the same result, rare shingles first give short lists. In long lists one member is compared with all others first, then pairs
    that are still apart.

    Defined results: texts without words, or null, have equal sets; a text of fewer words than a shingle is one shingle; repeated
    rows each get a row; an empty table gives no rows. Shingles stand for their 64-bit hashes.
    """
    spark, level = docs.sparkSession, Fraction(str(similarity))
    num, den = level.numerator, level.denominator
    prepare(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    every = max(1, docs.count() // SAMPLE_DOCS)
    sampled = source.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).mapInArrow(*_sets(words, seed)).select(F.explode("found").alias("shingle"))
    counted = sampled.groupBy("shingle").count().filter("count > 1").orderBy(F.desc("count"), "shingle").limit(COMMON).toArrow()
    names, counts = counted.column(0).to_numpy().view(np.uint64), counted.column(1).to_numpy()
    order = np.argsort(names)
    common = spark.sparkContext.broadcast((names[order], counts[order]))
    marked = cut(source.mapInArrow(*_set_marks(words, seed, level, common)))
    prints = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("smallest"), F.min("sim").alias("sim"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    entries = marked.select("fp", "n", F.posexplode("prefix").alias("pos", "shingle")).select("shingle", "fp", "n", F.col("pos").cast("long").alias("pos"))
    shared = cut(entries.repartition("shingle").sortWithinPartitions("shingle", "fp").mapInArrow(*_shared_lists()))
    marked = cut(marked.select("doc_id", "fp"))
    del entries, sampled
    tidy(spark)

    def paired(lists: DataFrame, star: bool) -> DataFrame:
        return lists.select("shingle", "fp", "n", "pos", "root", "bits").repartition("shingle").sortWithinPartitions("shingle", "n").mapInArrow(*_list_pairs(level, star))

    def confirmed(pairs: DataFrame) -> DataFrame:
        of = lambda p: prints.select(F.col("fp").alias(p), F.col("n").alias(f"n_{p}"), F.col("bits").alias(f"bits_{p}"))
        least = F.least(F.size("bits_a"), F.size("bits_b"))
        half = lambda c: F.when(F.size(c) == 2 * least, F.zip_with(F.slice(c, 1, least), F.slice(c, least + 1, least), lambda x, y: x.bitwiseXOR(y))).otherwise(F.slice(c, 1, least))
        apart = F.aggregate(F.zip_with(half("bits_a"), half("bits_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        differ = F.when(F.greatest(F.size("bits_a"), F.size("bits_b")) <= 2 * least, apart).otherwise(0)  # beyond that, only the sets tell
        total = F.col("n_a") + F.col("n_b")
        open_ = pairs.distinct().join(of("a"), "a").join(of("b"), "b").filter((total - differ) * (num + den) >= 2 * num * total)
        open_ = cut(open_.select("a", "b", total.alias("total")))
        need = prints.join(open_.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp", "left_semi").select("fp", "smallest")
        need = cut(need)
        ids = cut(need.select(F.col("smallest").alias("__id")).distinct())
        few = ids.count() <= BROADCAST_IDS
        texts = source.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
        sets = cut(texts.mapInArrow(*_sets(words, seed)).join(need.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]))
        with_sets = open_.join(sets.select(F.col("fp").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("found").alias("y")), "b")
        linked = cut(with_sets.filter(F.size(F.array_intersect("x", "y")) * (num + den) >= num * F.col("total")).select("a", "b"))
        del open_, need, ids, texts, sets, with_sets
        tidy(spark)
        return linked

    links = confirmed(_index_pairs(prints.select("fp", "sim"), limit))
    # Sets with the same smallest neighbour are connected already. A set has as many rows in the lists as shingles at most, so none is hot.
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = cut(both.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("root")).select("fp", F.least("fp", "root").alias("root"), F.lit(0).alias("hot")))
    apart = attach(shared, near, "fp", "hot", 1).withColumn("root", F.coalesce("root", "fp")).withColumn("bits", F.array().cast("array<long>"))
    links = links.unionByName(confirmed(paired(apart.filter(F.col("members") <= list_members), False).unionByName(paired(apart.filter(F.col("members") > list_members), True))))
    del apart, both, near
    roots = components(links)
    tidy(spark)
    long_ = shared.filter(F.col("members") > list_members)
    if not long_.isEmpty():
        rooted = long_.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")).join(prints.select("fp", "bits"), "fp")
        roots = components(links.unionByName(confirmed(paired(rooted, False))))
    return marked.select("doc_id", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("root"))


def _one_row_each(docs: DataFrame, found: DataFrame, prints, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs, unchanged, that stand for a component each: the one of the smallest id, null being the largest, and of equal
    ids the one of the smallest fp. found: doc_id, fp and root of each row; prints: the function of Arrow batches that makes fp."""
    found = cut(found.select("doc_id", "fp", "root"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp")).alias("k"))
    stays = cut(first.select(F.col("k.doc_id").alias("id"), F.col("k.fp").alias("fp")))
    repeated = cut(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    # The rows travel as one column, so that no name of theirs can clash.
    packed = docs.select(F.col(id_col).cast("long").alias("own"), F.struct("*").alias("row"))
    stay_ids = stays.select("id").distinct()
    some = lambda df, ids, name, how: df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col("own").eqNullSafe(F.col(name)), how)
    if repeated.isEmpty():
        # Fewer ids go than stay, so these are what is looked up where they are few.
        gone = found.select("doc_id").join(stays, F.col("doc_id").eqNullSafe(F.col("id")), "left_anti").distinct()
        return some(packed, cut(gone), "doc_id", "left_anti").select("row.*")
    kept = some(packed, stay_ids, "id", "left_semi")
    # Ids of several rows: their texts' own fp tells which row is meant, and rows that are equal in both are of one component.
    schema = pa.schema([("own", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            made = pa.Table.from_batches(list(prints(iter([batch.select([0, 1])])))).combine_chunks()
            yield pa.RecordBatch.from_arrays([batch.column(0), made.column("fp").combine_chunks().cast(schema.field("fp").type), batch.column(2)], names=["own", "print", "row"])

    several = some(kept, repeated, "doc_id", "left_semi").select("own", F.col("row").getField(text_col).cast("binary").alias("text"), "row")
    printed = several.mapInArrow(run, StructType([StructField("own", LongType()), StructField("print", LongType()), StructField("row", packed.schema["row"].dataType)]))
    right = printed.join(stays, F.col("own").eqNullSafe(F.col("id")) & (F.col("print") == F.col("fp")), "left_semi")
    return some(kept, repeated, "doc_id", "left_anti").select("row.*").unionByName(right.dropDuplicates(["own", "print"]).select("row.*"))


def drop_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, unchanged, of each group that similar_documents connects: that of the smallest id, null being the largest."""
    return _one_row_each(docs, similar_documents(docs, words, similarity, seed, id_col, text_col), _sets(words, seed)[0], id_col, text_col)
