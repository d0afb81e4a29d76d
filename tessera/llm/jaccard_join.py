"""N-gram Jaccard join by signature trees.

A document is the set of its distinct word shingles, as 64-bit hashes; two documents link when their sets have a
Jaccard similarity of at least NUMERATOR / DENOMINATOR. The join is exact and never forms all pairs:

1. Documents with equal sets form a class. Its set is looked at once, by its digest.
2. A token that only one document has cannot be shared. Of a set of n, at most n // 4 tokens may be missing in a
   partner, so of any n // 4 + 1 tokens, one is shared. Tokens are ordered by how many documents hold them, and
   those n // 4 + 1 that come first are the prefix; a set whose prefix holds unshared tokens only is done. The counts
   travel as packed arrays: one row per chunk of documents and range of hashes, out to the range and back.
3. Sets that share a prefix token get into one block (connected components); links never leave a block.
4. Within a block, signature trees are searched: nodes hold token bitmaps combined by OR and ranges of sizes, and a pair of
   nodes is followed only if the largest overlap that these allow reaches the least overlap that a link needs. Pairs
   that are connected already are skipped. What remains is compared in full. A large block is cut into leaves;
   neighbouring leaves are searched first, then those pairs of leaves that are not connected yet. For these, leaves
   travel in strips of neighbours, and a pair of strips is one search: a set is sent once for each strip of its block.
5. Links give components, and these go back to the documents.

Hot tokens never gather rows: a token is one entry per document in a packed array, and prefixes take the rarest first.

A-Z are lower-cased, words are runs without ASCII white space; fewer words than a shingle has make one shingle of all.
A null text, or one without words, has an empty set, links with nothing and is a component of its own. Rows with a
null identifier belong to the class of equal sets, and name no component; a set that only such rows hold is left alone.
Repeated rows are equal sets. An empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Roller, bounded, partitions, staged, tidy
from .components import components

SHINGLE = 5
NUMERATOR, DENOMINATOR = 3, 4
CHUNK_TOKENS, CHUNK_DOCS = 500_000, 20_000
LEAF = 48  # sets of a leaf of a large block
STRIP_TOKENS, STRIP_SETS = 500_000, 400  # tokens and sets of a strip of leaves, about: a search of two strips holds so many of each
NODE = 8  # sets of the lowest nodes of a tree
RANGE_TOKENS = 2_000_000  # tokens of a range of hashes, about: what a task holds does not grow with the input
BROADCAST_ROWS = 1_000_000  # identifiers sent to all executors at most (16 MB); beyond, they are joined by shuffle


def shingles(text: bytes, roll: Roller) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = roll.words(text.lower())
    return np.unique(roll.ngrams(words, min(SHINGLE, len(words)))) if len(words) else words


def _digest(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    roll = Roller()
    for b in batches:
        sets = [shingles(x or b"", roll) for x in b.column(2).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.int64())], names=["id", "h", "n", "digest"])


# ---- packed arrays: chunk -> range -> chunk -> range ---------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([a.nbytes for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    sizes = np.frombuffer(data, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(data, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


_PACKED = "to long, chunk long, part long, data binary"


def _packed(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["to", "chunk", "part", "data"])


def _out(ranges: int) -> Callable:
    """Chunks of sets, cut by range of hashes; ``part`` -1 holds the chunk's digests and set sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, sets, tokens, serial = Roller(), [], 0, TaskContext.get().partitionId() << 32

        def packed() -> pa.RecordBatch:
            all_ = np.concatenate(sets)
            size = np.array([len(s) for s in sets], np.uint32)
            doc = np.repeat(np.arange(len(sets), dtype=np.uint16), size)
            part = ((all_ >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            order = np.argsort(part.astype(np.uint32), kind="stable")
            cuts = np.searchsorted(part[order], np.arange(ranges + 1))
            low, doc = all_.astype(np.uint32)[order], doc[order]
            rows = [(int(r), serial, int(r), _pack(doc[a:b], low[a:b])) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            rows.append((serial % ranges, serial, -1, _pack(np.array([_digest(s) for s in sets], np.int64), size)))
            return _packed(rows)

        for b in batches:
            for x in b.column(0).cast(pa.binary()).to_pylist():
                s = shingles(x or b"", roll)
                if len(s):
                    sets.append(s)
                    tokens += len(s)
                if tokens >= CHUNK_TOKENS or len(sets) >= CHUNK_DOCS:
                    yield packed()
                    sets, tokens, serial = [], 0, serial + 1
        if sets:
            yield packed()

    return run


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one or more ranges: those tokens that more than one document holds, with how many do, for each chunk."""
    parts: dict[int, list[tuple[int, bytes]]] = {}
    for b in batches:
        for _, chunk, part, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if part < 0:
                yield _packed([(chunk, chunk, -1, data)])
            else:
                parts.setdefault(part, []).append((chunk, data))
    while parts:
        part, rows = parts.popitem()
        read = [(chunk, *_unpack(data, np.uint16, np.uint32)) for chunk, data in rows]
        ordered = np.sort(np.concatenate([low for _, _, low in read]))
        first = np.flatnonzero(np.diff(ordered, prepend=ordered[0] ^ np.uint32(1)) != 0)
        count = np.diff(np.append(first, len(ordered)))
        values, count = ordered[first][count > 1], count[count > 1]
        if not len(values):
            continue
        for chunk, doc, low in read:
            at = np.minimum(np.searchsorted(values, low), len(values) - 1)
            hit = values[at] == low
            if hit.any():
                yield _packed([(chunk, chunk, part, _pack(doc[hit], low[hit], np.minimum(count[at[hit]], 65535).astype(np.uint16)))])


def _prefixes(ranges: int) -> Callable:
    """Rows of whole chunks: prefix tokens of the sets that may have a partner, sent on by token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, list[tuple[int, bytes]]] = {}
        for b in batches:
            for _, chunk, part, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                chunks.setdefault(chunk, []).append((part, data))
        while chunks:
            chunk, rows = chunks.popitem()
            digest, size = _unpack(next(d for p, d in rows if p < 0), np.int64, np.uint32)
            found = [(p, *_unpack(d, np.uint16, np.uint32, np.uint16)) for p, d in rows if p >= 0]
            if not found:
                continue
            doc = np.concatenate([f[1] for f in found])
            token = np.concatenate([(np.uint64(f[0]) << np.uint64(32)) | f[2] for f in found])
            held = np.concatenate([f[3] for f in found])
            shared = np.bincount(doc, minlength=len(size))
            need = prefix_length(size.astype(np.int64)) - (size - shared)
            some = need[doc] > 0
            doc, token, held = doc[some], token[some], held[some]
            order = np.lexsort((token, held, doc))
            doc, token = doc[order], token[order]
            start = np.searchsorted(doc, np.arange(len(size)))
            take = np.arange(len(doc)) - start[doc] < need[doc]
            doc, token = doc[take], token[take]
            _, once = np.unique(np.stack([token.view(np.int64), digest[doc]], axis=1), axis=0, return_index=True)
            doc, token = doc[once], token[once]
            to = (token * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(ranges)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(ranges + 1))
            rows = [(r, chunk, r, _pack(token[order[a:b]], digest[doc[order[a:b]]])) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            if rows:
                yield _packed(rows)

    return run


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Of so many tokens of a set of ``n``, a linked partner has one at least: it has NUMERATOR / DENOMINATOR of all."""
    return n - (n * NUMERATOR + DENOMINATOR - 1) // DENOMINATOR + 1


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one or more ranges: edges from the least digest that holds a prefix token to the others that do."""
    parts: dict[int, list[bytes]] = {}
    for b in batches:
        for part, data in zip(b.column("part").to_pylist(), b.column("data").to_pylist(), strict=True):
            parts.setdefault(part, []).append(data)
    while parts:
        _, rows = parts.popitem()
        read = [_unpack(d, np.uint64, np.int64) for d in rows]
        token, digest = np.concatenate([r[0] for r in read]), np.concatenate([r[1] for r in read])
        order = np.lexsort((digest, token))
        token, digest = token[order], digest[order]
        first = np.flatnonzero(np.diff(token, prepend=token[0] ^ np.uint64(1)) != 0)
        least = np.repeat(digest[first], np.diff(np.append(first, len(token))))
        pairs = np.stack([digest, least], axis=1)[digest != least]
        pairs = np.unique(pairs, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def _blocks(docs: DataFrame, ranges: int) -> DataFrame:
    """(node, label): digests of sets that may link, and their block."""
    out = docs.select("text").mapInArrow(tidy(_out(ranges)), _PACKED).repartition(ranges, "to")
    back = out.mapInArrow(tidy(_back), _PACKED).repartition(ranges, "to")
    edges = back.mapInArrow(tidy(_prefixes(ranges)), _PACKED).repartition(ranges, "to").mapInArrow(tidy(_stars), "u long, v long")
    return components(edges, "jaccard-blocks")


# ---- signature trees -----------------------------------------------------------------------------------------------


class Forest:
    """Union of members that are known to be connected."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def least_overlap(a: int, b: int) -> int:
    """Tokens that two sets of these sizes share if they link."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


class SignatureTree:
    """Sets under binary trees, one for each side, of nodes with OR-combined bitmaps and size ranges."""

    def __init__(self, sets: list[np.ndarray], bits: int, sides: list[int]) -> None:
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0])))
        self.maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(sets):
            at = (s & np.uint64(bits - 1)).astype(np.int64)
            row = np.zeros(bits, np.uint8)
            row[at] = 1
            self.maps[i] = np.packbits(row, bitorder="little").view(np.uint64)
        self.size = np.array([len(s) for s in sets])
        self.extra = self.size - np.bitwise_count(self.maps).sum(axis=1).astype(np.int64)  # tokens that fell on a taken bit
        self.nodes: list[tuple] = []  # bitmap, least and largest size, most extra, children or members
        self.tops = [self._tree([i for i in order if sides[i] == side]) for side in sorted(set(sides))]

    def _tree(self, members: list[int]) -> int:
        level = [self._node(members[k : k + NODE]) for k in range(0, len(members), NODE)]
        while len(level) > 1:
            level = [self._over(level[k : k + 2]) for k in range(0, len(level), 2)]
        return level[0]

    def _node(self, members: list[int]) -> int:
        self.nodes.append((np.bitwise_or.reduce(self.maps[members]), self.size[members].min(), self.size[members].max(), self.extra[members].max(), None, members))
        return len(self.nodes) - 1

    def _over(self, below: list[int]) -> int:
        if len(below) == 1:
            return below[0]
        n = [self.nodes[k] for k in below]
        self.nodes.append((n[0][0] | n[1][0], min(x[1] for x in n), max(x[2] for x in n), max(x[3] for x in n), below, n[0][5] + n[1][5]))
        return len(self.nodes) - 1

    def may_link(self, x: tuple, y: tuple) -> bool:
        """Can the largest overlap of two nodes' sets reach what a link needs?"""
        if min(x[2], y[2]) * DENOMINATOR < NUMERATOR * max(x[1], y[1]):
            return False
        most = min(int(np.bitwise_count(x[0] & y[0]).sum()) + min(x[3], y[3]), x[2], y[2])
        return most >= least_overlap(int(x[1]), int(y[1]))


def search(sets: list[np.ndarray], forest: Forest, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect, by dual traversal, all sets that links connect and ``forest`` does not yet. With two ``sides``, only links between them are looked for."""
    if len(sets) < 2:
        return []
    bits = 256
    while bits < 4 * np.median([len(s) for s in sets]) and bits < 1 << 15:
        bits *= 2
    tree = SignatureTree(sets, bits, sides or [0] * len(sets))
    links, todo = [], [(tree.tops[0], tree.tops[-1])]
    while todo:
        a, b = todo.pop()
        x, y = tree.nodes[a], tree.nodes[b]
        if a != b and not tree.may_link(x, y):
            continue
        roots = {forest.root(i) for i in x[5]}
        if len(roots) == 1 and all(forest.root(j) in roots for j in y[5]):
            continue
        if x[4] is None and y[4] is None:
            for k, i in enumerate(x[5]):
                for j in x[5][k + 1 :] if a == b else y[5]:
                    if forest.root(i) == forest.root(j):
                        continue
                    need = least_overlap(len(sets[i]), len(sets[j]))
                    if min(len(sets[i]), len(sets[j])) < need or int(np.bitwise_count(tree.maps[i] & tree.maps[j]).sum()) + min(tree.extra[i], tree.extra[j]) < need:
                        continue
                    small, large = sorted((sets[i], sets[j]), key=len)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    if int((large[at] == small).sum()) >= need:
                        forest.join(i, j)
                        links.append((i, j))
        elif a == b:
            l, r = x[4]
            todo += [(l, r), (r, r), (l, l)]  # near ones first: the last goes first
        elif y[4] is None or (x[4] is not None and len(x[5]) >= len(y[5])):
            todo += [(k, b) for k in x[4]]
        else:
            todo += [(a, k) for k in y[4]]
    return links


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile: links (u, v) between the classes of each tile, or of its two sides. ``label``: rows with equal ones are connected already."""
    tile, rows = None, []

    def found() -> pa.RecordBatch:
        forest, seen = Forest(len(rows)), {}
        for i, (_, label, _, _) in enumerate(rows):
            forest.join(seen.setdefault(label, i), i)
        links = search([np.frombuffer(s, np.uint64) for _, _, s, _ in rows], forest, [side for _, _, _, side in rows])
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i, _ in links], pa.int64()), pa.array([rows[j][0] for _, j in links], pa.int64())], names=["u", "v"])

    for b in batches:
        for t, *row in zip(*(b.column(c).to_pylist() for c in ("tile", "node", "label", "set", "side")), strict=True):
            if t != tile:
                if len(rows) > 1:
                    yield found()
                tile, rows = t, []
            rows.append(row)
    if len(rows) > 1:
        yield found()


def _tiles(rows: DataFrame, ranges: int) -> DataFrame:
    rows = rows.select("tile", "node", "label", "set", "side")
    return rows.repartition(ranges, "tile").sortWithinPartitions("tile", "node").mapInArrow(tidy(_searched), "u long, v long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    roll = Roller()
    for b in batches:
        sets = [shingles(x or b"", roll) for x in b.column("text").cast(pa.binary()).to_pylist()]
        keep = [i for i, n in enumerate(b.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*(b.schema.names[i] for i in keep), "n", "digest", "set"])


def _text_hash(text: Column) -> Column:
    """Tells the texts of one identifier apart."""
    return F.xxhash64(F.lit(7), text.cast("string"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h (a hash of the text), n_shingles, component_id, n_classes of each row."""
    spark: SparkSession = docs.sparkSession
    texts = bounded(docs).select(F.col(f"`{id_col}`").cast("long").alias("id"), _text_hash(F.col(f"`{text_col}`")).alias("h"), F.col(f"`{text_col}`").cast("string").alias("text"))
    info = staged(texts.mapInArrow(tidy(_described), "id long, h long, n long, digest long"), "jaccard-info")
    ranges = max(partitions(spark), (info.agg(F.sum("n")).first()[0] or 0) // RANGE_TOKENS)
    classes = staged(info.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep")), "jaccard-classes")

    blocks = _blocks(texts, ranges)
    # one document of each class that is in a block, with its whole set
    size = blocks.groupBy("label").agg(F.count("*").alias("members"))
    size = staged(size, "jaccard-sizes")
    blocks = blocks.join(size, "label").select(F.col("node"), F.col("label").alias("block"), F.greatest(F.lit(1), F.ceil(F.col("members") / LEAF)).cast("long").alias("leaves"))
    members = staged(blocks.join(classes, F.col("node") == F.col("digest")).select("node", "block", "leaves", "rep"), "jaccard-members")
    n = members.count()
    sets = texts.join(_small(members, n), F.col("id") == F.col("rep")).select("node", "block", "leaves", "text")
    sets = sets.mapInArrow(tidy(_sets), "node long, block long, leaves long, n long, digest long, set binary").where("digest = node")  # another text of the same identifier
    # leaves by size first, so that neighbours are alike
    by_size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DENOMINATOR / NUMERATOR)))
    leaf = F.concat_ws("-", F.lpad(by_size.cast("string"), 4, "0"), F.lpad(F.pmod(F.xxhash64("node"), F.col("leaves")).cast("string"), 9, "0"))
    sets = staged(sets.withColumn("leaf", F.when(F.col("leaves") > 1, leaf).otherwise("")), "jaccard-sets")

    small = sets.where("leaves = 1").select(F.concat_ws("/", F.col("block").cast("string"), F.lit("")).alias("tile"), "node", F.col("node").alias("label"), "set", F.lit(0).alias("side"))
    large = sets.where("leaves > 1")
    groups = staged(large.groupBy("block", "leaf").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("tokens"), F.count("*").alias("sets")), "jaccard-leaves")
    many = not groups.isEmpty()
    tiles = small
    if many:
        order = Window.partitionBy("block").orderBy("leaf")
        near = groups.select("block", "leaf", F.array(F.col("leaf"), F.lag("leaf").over(order)).alias("tiles"))
        near = near.select("block", "leaf", F.explode("tiles").alias("at")).where("at IS NOT NULL")
        first = large.join(near, ["block", "leaf"]).select(F.concat_ws("/", F.col("block").cast("string"), "at").alias("tile"), "node", F.col("node").alias("label"), "set", F.lit(0).alias("side"))
        tiles = small.unionByName(first)
    links = staged(_tiles(tiles, ranges), "jaccard-links")
    labels = components(links, "jaccard-links")
    if many:
        known = large.join(labels, "node", "left").select("block", "leaf", "node", F.coalesce("label", "node").alias("label"), "set")
        state = known.groupBy("block", "leaf").agg(F.min("label").alias("low"), F.max("label").alias("high")).join(groups, ["block", "leaf"])
        state = staged(state.withColumn("strip", F.floor(F.sum(F.greatest(F.col("tokens") / STRIP_TOKENS, F.col("sets") / STRIP_SETS)).over(order))), "jaccard-state")
        a, b = state.alias("a"), state.alias("b")
        fits = (F.least("a.most", "b.most") * DENOMINATOR >= F.greatest("a.least", "b.least") * NUMERATOR) & ~((F.col("a.low") == F.col("a.high")) & (F.col("b.low") == F.col("b.high")) & (F.col("a.low") == F.col("b.low")))
        rest = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.leaf") < F.col("b.leaf")) & fits)
        # a pair of leaves is searched in the tile of their strips, to which each of its leaves is sent once
        tile = F.concat_ws("/", F.col("a.block").cast("string"), F.col("a.strip").cast("string"), F.col("b.strip").cast("string"))
        ends = F.array(F.struct(F.col("a.leaf").alias("leaf"), F.lit(0).alias("side")), F.struct(F.col("b.leaf").alias("leaf"), (F.col("a.strip") < F.col("b.strip")).cast("int").alias("side")))
        rest = rest.select(F.col("a.block").alias("block"), tile.alias("tile"), F.explode(ends).alias("end")).select("block", "tile", "end.leaf", "end.side").distinct()
        rest = staged(rest, "jaccard-rest")
        if not rest.isEmpty():
            more = _tiles(known.join(rest, ["block", "leaf"]), ranges)
            labels = components(links.unionByName(staged(more, "jaccard-links")), "jaccard-links")

    # back to the documents: a component is named by its smallest identifier
    named = classes.join(labels, F.col("digest") == F.col("node"), "left").select("digest", "rep", F.coalesce("label", "digest").alias("group"))
    named = staged(named, "jaccard-named")
    least = staged(named.groupBy("group").agg(F.min("rep").alias("component_id"), F.count("*").alias("n_classes")), "jaccard-least")
    named = staged(named.join(least, "group").select(F.col("digest").alias("d"), "component_id", "n_classes"), "jaccard-named")
    joined = info.join(named, F.col("digest") == F.col("d"), "left")
    return joined.select("id", "h", F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_classes", F.lit(1)).alias("n_classes"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, n_classes (different sets in the component)."""
    return _components(docs, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", "component_id", "n_classes")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest identifier; all columns as they were.

    Rows without an identifier, without words, or without a partner stay, and so do all rows of the document that stays. Of
    several texts under one identifier, only those go that are near another document. An empty table gives an empty one.
    """
    found = _components(docs, id_col, text_col).where("id <> component_id").select(F.col("id").alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    gone = staged(found, "jaccard-gone")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), _text_hash(F.col(f"`{text_col}`")).alias("h"))
    left = rows.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("h") == F.col("gone_h")), "left_anti")
    return left.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
