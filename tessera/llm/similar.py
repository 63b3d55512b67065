"""Near-duplicates by word shingles: SimHash candidates, exact Jaccard similarity.

A text is the set of its shingles' 64-bit hashes, and equal sets are one *node*.
Two sets of a Jaccard similarity of ``t`` or more share one of the ``(1 - t) * n + 1``
first hashes of each in any order that is the same for all, so every node is filed under
these and met there.  The order has *common* shingles last, those in more than ``COMMON``
texts, and otherwise follows the hash: texts that share a passage and have a fifth of their
own don't meet by it.  Where two sets share the first key that they have in common, no more
than what follows it in either can be common, so a meeting passes over pairs for which that
is too few.  Which shingles are common is only a matter of cost; any choice loses no pair.

Each meeting also compares SimHash fingerprints.  For independent bits, those of two
equally large sets with a similarity of 0.8 are ten bits apart on average and more
than ``FAR`` bits for four pairs in a hundred thousand; of unrelated sets 99 % are
farther apart.  What is left is compared by whole sets, of 32 bits of each hash, so
sets of 600 shingles see an equal pair that isn't once in twelve thousand comparisons.

A radius of twelve bits by segments alone would not do: some segment of three then
has up to four errors, and the Golay keys within its reach are 5 % of all keys.

A key meets each node with the ``WIDE`` before it in node order.  The pair with most
common keys of each node is compared first, and the others only where the groups
found so far leave them apart.  A *crowded* key, of more nodes, may hold pairs that
were not met.  Where its nodes are of several groups by then, all pairs of different
groups meet in a last round: nodes are dealt into cells of about ``CELL`` by size and
hash, cells of comparable sizes meet in pairs, each in one task (a key of at most
``CELL`` nodes is one cell), and sketches of 256 bits (unrelated sets differ in 128, sets of a similarity of 0.8 in 40, or 48 if they
are very small) leave those within ``FAR_SKETCH`` to be compared by whole sets.
Keys that aren't common have at most ``COMMON`` nodes, so their cost follows the input; only
texts made of common shingles for the most part meet in larger ones, and there the cost
grows with the square of those that earlier rounds leave in different groups.

Whole sets are compared in two steps, since a set travels once for each of its pairs.
The first has 16 bits of each hash, a byte or so once they are written as gaps; what is
common to two sets is common to these too, so no similar pair is lost there.

Where a distance is given, the SimHash method itself comes first: fingerprints of three-word
shingles linked through Golay keys of their segments and the pigeonhole principle, as
``simhash.py`` has it.  Its groups stand, and the comparison of sets adds to them.

A text of fewer words than a shingle is one shingle.  Texts without words, and
nulls, are one group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import REQUEST_SCHEMA, arrow_batches, bucket_count, checkpoint, requests, unpack_sorted
from .simhash import components, fingerprints, links
from .textbytes import BLANKS, grams, slices

SHINGLE = 5
SIMILARITY = 0.8
FAR = 22
SMALL = 20
FAR_SMALL = 28
WIDE = 16
COMMON = 256
#: The most common shingles that are put last; beyond, those of most texts are.
MOST_COMMON = 1 << 20
#: Shingles that a task counts at once, and the bits of each by which they are counted.
COUNTED = 1 << 21
COUNTED_BITS = np.uint64(0xFFFFFFFF00000000)
CELL = 1 << 14
FAR_SKETCH = 80
#: Bytes of an Arrow batch: ten thousand pairs of whole sets would take a task some hundred megabytes on either side.
BATCH_BYTES = 4 << 20
#: Nodes that are compared with others at once are so many pairs.
COMPARED = 1 << 18
#: Odd multipliers that make four further hashes of a shingle's.
MIXERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
#: Bits of the map of nodes to compare, and the most that are set one by one; beyond, every set is sent.
SLOTS = 1 << 26
MOST_SLOTS = 1 << 22


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    for part in slices(texts, BLANKS, lower=True):
        words = part.hashes()
        whole = grams(words, shingle)
        for r in range(part.rows):
            a, b = int(part.word_at[r]), int(part.word_at[r + 1])
            yield np.unique(whole[a : b - shingle + 1] if b - a >= shingle else grams(words[a:b], b - a, seed=b - a) if b > a else words[:0])


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def print_of(shingles: np.ndarray) -> int:
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > shingles.size, bitorder="little").view("<i8")[0])


def sketch_of(shingles: np.ndarray) -> bytes:
    """A SimHash of 256 bits."""
    votes = np.zeros(256, np.int64)
    for at in range(0, shingles.size, 1 << 15):
        mixed = shingles[at : at + (1 << 15), None] * MIXERS
        mixed = (mixed ^ (mixed >> np.uint64(29))) * MIXERS[::-1]
        mixed ^= mixed >> np.uint64(32)
        votes += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * votes > shingles.size, bitorder="little").tobytes()


def gaps_of(values: np.ndarray) -> bytes:
    """Sorted 16-bit values, repeats included, as the bytes of their gaps; 255 stands for 255 and more to come."""
    gaps = np.diff(values.astype(np.int64), prepend=0)
    out = np.full(int((gaps // 255 + 1).sum()), 255, np.uint8)
    out[np.cumsum(gaps // 255 + 1) - 1] = gaps % 255
    return out.tobytes()


def values_of(gaps: bytes) -> np.ndarray:
    """The values of ``gaps_of``, each times 2^32 with the number of equal ones before it added, so that all are distinct."""
    read = np.frombuffer(gaps, np.uint8)
    values = np.cumsum(read, dtype=np.int64)[read < 255]
    return (values << 32) + np.arange(values.size) - np.searchsorted(values, values)


def meetings(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of different groups with near sketches; rows come in the order of their meeting.

    ``rest``, if given, is how many of a node's ``n`` shingles aren't before the meeting's key.
    """
    held: list[pa.RecordBatch] = []
    share = common_share(similarity)

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        side, node, n, root = (rows.column(c).to_numpy() for c in ("side", "node", "n", "root"))
        rest = rows.column("rest").to_numpy() if "rest" in rows.column_names else n
        if (root == root[0]).all():
            return
        bits = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(-1, 4)
        for left, right in ((0, 1), (2, 2)):
            # In order of size, so that only a range of the others is of a comparable one.
            x, all_y = (chosen[np.argsort(n[chosen], kind="stable")] for chosen in (np.flatnonzero(side == left), np.flatnonzero(side == right)))
            step = max(1, COMPARED // max(1, all_y.size))
            for at in range(0, x.size if all_y.size else 0, step):
                p = x[at : at + step, None]
                low, high = np.searchsorted(n[all_y], [similarity * n[p[0, 0]] - 1e-6, n[p[-1, 0]] / similarity + 1e-6])
                y = all_y[low:high]
                near = (root[p] != root[y]) & (np.minimum(rest[p], rest[y]) >= share * (n[p] + n[y]) - 1e-6)
                if left == right:
                    near &= np.arange(at, at + p.size)[:, None] < np.arange(low, low + y.size)
                i, j = np.nonzero(near)
                i, j = x[at + i], y[j]
                close = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) <= FAR_SKETCH
                i, j = node[i[close]], node[j[close]]
                if i.size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["a", "b"])

    for batch in batches:
        ids = batch.column("meeting").to_numpy()
        if not ids.size:
            continue
        if held and held[-1].column("meeting")[0].as_py() != ids[0]:
            yield from pairs(pa.Table.from_batches(held))
            held = []
        at = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), ids.size]
        for start, end in zip(at, at[1:], strict=False):
            if start and held:
                yield from pairs(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield from pairs(pa.Table.from_batches(held))


def prefix_size(n: int, similarity: float) -> int:
    """So many of a set's ``n`` least hashes hold one of any set that is similar enough."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1


def common_share(similarity: float) -> float:
    """The part of two sets' sizes together that similar ones have in common at least."""
    return similarity / (1 + similarity)


def common_shingles(texts: DataFrame, shingle: int, keys: int, common: int) -> Broadcast:
    """A map of the slots of shingles that more than ``common`` rows have, for ``last_if_common``.

    ``keys`` is about how many shingles all texts have. They are counted by 32 bits and their slots have
    26, so that a few others share a bit; if there are more than ``MOST_COMMON``, the map has the most frequent.
    """
    buckets = bucket_count(texts.sparkSession, keys)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for s in shingle_sets(batch.column("text"), shingle):
                held.append(s & COUNTED_BITS)
                size += s.size
                if size >= COUNTED:
                    found, times = np.unique(np.concatenate(held), return_counts=True)
                    yield requests(0, buckets, found, times.astype(np.uint32))
                    held, size = [], 0
        if size:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            yield requests(0, buckets, found, times.astype(np.uint32))

    def merged(bucket: pa.Table) -> pa.Table:
        parts = [unpack_sorted(blob) for blob in bucket.column("blob").to_pylist()]
        found, times = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.argsort(found, kind="stable")
        found = found[order]
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        total = np.add.reduceat(times[order].astype(np.int64), first)
        many = total > common
        return pa.table({"node": slots_of(found[first[many]]), "level": np.floor(4 * np.log2(total[many])).astype(np.int32)})

    found = checkpoint(texts.mapInArrow(counted, REQUEST_SCHEMA).groupBy("bucket").applyInArrow(merged, "node long, level int"))
    lowest, left = 1 << 10, MOST_COMMON
    for level, many in sorted(found.groupBy("level").count().collect(), reverse=True):
        left -= many
        if left < 0:
            break
        lowest = level
    return wanted(found.filter(F.col("level") >= lowest))


def slots_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(38)).astype(np.int64)


def last_if_common(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    late = marked(common, slots_of(shingles)) == 1
    return np.concatenate([shingles[~late], shingles[late]])


def in_cells(members: DataFrame, similarity: float, cell: int) -> DataFrame:
    """A row of ``members`` (key, node, n, many: nodes of the key, ...) for each meeting of its cell with one of comparable sizes."""
    whole = members.filter(F.col("many") <= cell).select(F.xxhash64("key").alias("meeting"), F.lit(2).alias("side"), *members.columns)
    # Sizes whose ratio is ``similarity`` or more are of one band or of neighbouring ones.
    banded = members.filter(F.col("many") > cell).withColumn("band", F.expr(f"cast(floor(ln(n) / ({-np.log(similarity)}D + 1e-6D)) as int)"))
    counts = banded.groupBy("key", "band").agg(F.expr(f"cast(ceil(count(*) / {cell}) as int)").alias("cells"))
    for name, shift in (("own", 0), ("after", -1), ("before", 1)):
        banded = banded.join(counts.selectExpr("key", f"band + {shift} as band", f"cells as {name}"), ["key", "band"], "left")
    cut = banded.withColumn("cell", F.expr("cast(pmod(xxhash64(node, 7), own) as int)"))

    def turns(cells: str, side: str, low: str, high: str) -> str:
        each = f"t -> named_struct('side', {side}, 'meeting', xxhash64(key, {low}, {high}))"
        return f"transform(if(coalesce({cells}, 0) > 0, sequence(0, {cells} - 1), array()), {each})"

    own = turns("own", "cast(if(t = cell, 2, if(t > cell, 0, 1)) as int)", "band, least(t, cell)", "band, greatest(t, cell)")
    after = turns("after", "0", "band, cell", "band + 1, t")
    before = turns("before", "1", "band - 1, t", "band, cell")
    met = cut.withColumn("turn", F.expr(f"explode(concat({own}, {after}, {before}))"))
    return whole.unionByName(met.select("turn.meeting", "turn.side", *members.columns))


def wanted(nodes: DataFrame) -> Broadcast:
    """A map with the bits of all ``nodes.node`` set."""
    slots = nodes.select(F.expr(f"cast(node & {SLOTS - 1} as int) as slot")).distinct()
    slots = slots.limit(MOST_SLOTS + 1).toArrow().column("slot").to_numpy()
    found = np.full(SLOTS // 8, 255 if slots.size > MOST_SLOTS else 0, np.uint8)
    np.bitwise_or.at(found, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    return nodes.sparkSession.sparkContext.broadcast(found)


def marked(found: np.ndarray, nodes: int | np.ndarray) -> int | np.ndarray:
    """1 where the bits of nodes are set: all that were wanted and a few others."""
    return found[(nodes & (SLOTS - 1)) >> 3] >> (nodes & 7) & 1


def similar_groups(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, text: str = "text", doc_id: str = "doc_id", wide: int = WIDE, cell: int = CELL, distance: int | None = None, common: int = COMMON
) -> DataFrame:
    """(doc_id, text_hash, root) of each row: rows of one group have one root.

    With ``distance``, texts whose fingerprints (``simhash.py``) differ in so many bits or less are
    linked first, by their Golay keys, and only texts that this leaves apart are compared as sets.
    """

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = [(node_of(s), s.size) for s in shingle_sets(texts, shingle)]
            node, n = (pa.array(v, pa.int64()) for v in (zip(*found, strict=True) if found else ([], [])))
            prints = pa.nulls(batch.num_rows, pa.int64()) if distance is None else pa.array(fingerprints(texts).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), node, prints, n], ["doc_id", "text_hash", "node", "print", "n"])

    def printed() -> DataFrame:
        """Links (a, b) of each node with the smallest one of its fingerprint's group."""
        own = rows.groupBy("node", "print").count().select("node", F.col("print").alias("fp"))
        own = checkpoint(own)
        near = checkpoint(components(links(own.select("fp").distinct(), distance)))
        own = own.join(near.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        least = own.groupBy("root").agg(F.min("node").alias("b"))
        return checkpoint(own.join(least, "root").filter("node <> b").select(F.col("node").alias("a"), "b"))

    def apart_of(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """The pairs that ``roots`` leave in different groups."""
        for end in ("a", "b"):
            pairs = pairs.join(roots.selectExpr(f"node as {end}", f"root as root_{end}"), end, "left")
        return pairs.filter("coalesce(root_a, a) <> coalesce(root_b, b)").drop("root_a", "root_b")

    def filed(late: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in shingle_sets(batch.column("text"), shingle):
                    # Smaller sets are similar to equal ones only.
                    if prefix_size(s.size + 1, similarity) > 1 and s.size:
                        k = prefix_size(s.size, similarity)
                        same = [np.full(k, v, t) for v, t in ((node_of(s), np.int64), (print_of(s), np.int64), (s.size, np.int32))]
                        rest = s.size - np.arange(k, dtype=np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(last_if_common(s, late.value)[:k].view(np.int64)), *map(pa.array, same), pa.array(rest)], ["key", "node", "fp", "n", "rest"])

        return emit

    def whole(among: Broadcast, brief: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(node_of(s), s) for s in shingle_sets(batch.column("text"), shingle)]
                found = [(v, np.unique((s >> np.uint64(32)).astype(np.uint32))) for v, s in found if marked(among.value, v)]
                found = [(v, gaps_of(s >> 16) if brief else s.tobytes()) for v, s in found]
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], ["node", "shingles"])

        return emit

    def sketched(among: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(node_of(s), s) for s in shingle_sets(batch.column("text"), shingle)]
                found = [(v, sketch_of(s)) for v, s in found if marked(among.value, v)]
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], ["node", "sketch"])

        return emit

    def alike(read: Callable[[bytes], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = ([read(v) for v in batch.column(c).to_pylist()] for c in ("x", "y"))
                common = np.array([np.intersect1d(p, q, assume_unique=True).size for p, q in zip(x, y, strict=True)], np.int64)
                either = np.array([p.size + q.size for p, q in zip(x, y, strict=True)], np.int64) - common
                yield batch.select(["a", "b"]).filter(pa.array(common >= similarity * either - 1e-9))

        return emit

    def sets_of(pairs: DataFrame, brief: bool) -> DataFrame:
        among = wanted(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        return checkpoint(source.select("text").mapInArrow(whole(among, brief), "node long, shingles binary").dropDuplicates(["node"]))

    def checked(pairs: DataFrame, sets: DataFrame, read: Callable[[bytes], np.ndarray]) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        return checkpoint(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(alike(read), "a long, b long"))

    def compared(pairs: DataFrame, briefs: DataFrame) -> DataFrame:
        left = checked(pairs, briefs, values_of)
        return checked(left, sets_of(left, brief=False), lambda v: np.frombuffer(v, np.uint32))

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        rows = checkpoint(source.mapInArrow(nodes, "doc_id long, text_hash long, node long, print long, n long"))
        linked = None if distance is None else printed()
        late = common_shingles(source.select("text"), shingle, rows.agg(F.sum("n")).first()[0] or 0, common)
        keys = source.select("text").mapInArrow(filed(late), "key long, node long, fp long, n int, rest int").repartition("key").dropDuplicates(["key", "node"])
        by = "over (partition by key order by node rows between"
        before = f"collect_list(struct(node, fp, n, rest)) {by} {wide} preceding and 1 preceding) as met"
        crowd = f"count(*) {by} unbounded preceding and unbounded following) > {wide + 1} as crowded"
        near = f"m -> bit_count(m.fp ^ fp) <= if(n < {SMALL}, {FAR_SMALL}, {FAR}) AND least(m.rest, rest) >= {common_share(similarity)}D * (m.n + n) - 1e-6D"
        met = keys.selectExpr("key", "node", "fp", "n", "rest", before, crowd).filter("size(met) > 0 or crowded")
        met = checkpoint(met.selectExpr("key", "node", "n", "rest", "crowded", f"filter(met, {near}).node as met").filter("size(met) > 0 or crowded"))
        pairs = met.selectExpr("explode(met) as a", "node as b").groupBy("a", "b").count()
        pairs = checkpoint(pairs if linked is None else apart_of(pairs, components(linked)))
        sets = sets_of(pairs, brief=True)
        first = pairs.groupBy("b").agg(F.max(F.struct("count", "a")).alias("best")).selectExpr("best.a as a", "b")
        edges = compared(first, sets)
        edges = edges if linked is None else edges.unionByName(linked)
        roots = checkpoint(components(edges))
        apart = apart_of(pairs.select("a", "b").join(first, ["a", "b"], "left_anti"), roots)
        edges = edges.unionByName(compared(apart, sets))
        roots = checkpoint(components(edges))
        crowded = met.filter("crowded").select("key", "node", "n", "rest").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = crowded.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("many")).filter("least < most").select("key", "many")
        crowded = checkpoint(crowded.join(mixed, "key"))
        if not crowded.isEmpty():
            sketches = source.select("text").mapInArrow(sketched(wanted(crowded.select("node"))), "node long, sketch binary").dropDuplicates(["node"])
            cells = in_cells(crowded.select("key", "node", "n", "rest", "root", "many").join(sketches, "node"), similarity, cell)
            cells = cells.select("meeting", "side", "node", "n", "rest", "root", "sketch").repartition("meeting").sortWithinPartitions("meeting")
            pairs = checkpoint(cells.mapInArrow(lambda batches: meetings(batches, similarity), "a long, b long").distinct())
            if not pairs.isEmpty():
                roots = checkpoint(components(edges.unionByName(compared(pairs, sets_of(pairs, brief=True)))))
        return rows.join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))
