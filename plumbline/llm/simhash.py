"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints. Texts are lowered in A-Z and split at ASCII white space; every
shingle of ``shingle`` words is hashed with XXH64 and a bit of the fingerprint is
1 if it is set in over half of the hashes, repeats included.

Links. Two fingerprints are linked if they differ in at most ``radius`` bits.
``masks`` gives 2**(radius + 1) - 1 structured bit masks: bit i gets the nonzero
vector 1 + i mod (2**(radius + 1) - 1) over GF(2), and mask v keeps the bits whose
vector has an odd product with v. Any ``radius`` vectors are orthogonal to some
nonzero v, so every pair within the radius agrees under some mask: no link is
missed. Equal fingerprints are first reduced to one.

Within a bucket pairs are never listed. For the even part of the radius each
member sends itself to the points ("hubs") reached by flipping up to radius / 2
of the bits that the mask leaves out; two fingerprints meet in a hub exactly if
they differ in at most twice as many bits there, all outside the mask. A bucket
of m members thus makes a number of rows linear in m. For an odd radius the last
bit is flipped on one side only, which keeps the count linear as well.

Groups. Hubs link their members to the least of them, and connected components
follow by alternating large-star and small-star steps, each written to the shared
folder, so the number of rounds grows with the logarithm of the longest chain.
What is joined on a node is written first, so that Spark can split hot nodes.

Similar texts. Texts that share ``similarity`` of their ``SIMILAR_WORDS``-word shingles
mostly differ in more bits than a covering family can bear. ``groups`` can therefore
add links of that kind by MinHash: of every text, long or short, the least value of its
shingles under each of ``BANDS`` x ``ROWS`` hash functions is taken, and texts that agree
in all rows of a band share a bucket. A pair of similarity J shares one with probability
1 - (1 - J**ROWS)**BANDS, whatever its length: 0.99994 at 0.8. Nodes are distinct texts,
so that texts of an equal fingerprint keep their own buckets. A member is compared, by
its whole text, with three members of each of its buckets: the least and the greatest, in
one of four orders that the bucket's key picks, and the hub, the one that meets most texts
over all its buckets. So rows stay linear in a bucket's size, and buckets of up to three
have all their pairs compared. A link counts if the similarity is reached.

What larger buckets leave over is found exactly. If the links so far make one group of a
bucket, nothing is left there. The texts of all others ("open") are joined by prefixes:
their shingles are put in one order, rare ones first, and two texts that reach the
similarity share a shingle among the first fifth or so of each (the lesser text's among a
ninth, at 0.8). All pairs of open texts that meet there in different groups and have room
for the similarity by size and place are compared by their whole texts. So every pair that
shares a bucket is compared, ruled out by a bound, or in one group already.

Defined results: null, empty and blank texts have fingerprint zero and are linked
like any other; every row is a node of its own and repeated rows share a group; a
null id is the least of a group only if the group has no other; an empty table
yields no rows; other columns are ignored. ``representatives`` keeps one row of each
group, that of the least id (null last) and of its rows that of the least text digest,
whatever ids repeat or are null, with all columns as they came; of rows that are equal
in id and text any one stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches, dropped, free, pairs, written

SEED = 42
SIMILAR_WORDS = 5
#: Bands of MinHash values and values in each.
BANDS, ROWS = 32, 6
WIDTH = 64
#: Shingles whose hashes are counted at once.
BLOCK = 1 << 15
#: Shingles whose values under all hash functions are made at once.
MIN_BLOCK = 256
#: Bins in which the shingles of open texts are counted; texts' shingles are taken from the rarest bin on.
BINS = 1 << 20
#: What rounding may take from a bound.
SLACK = 1e-6
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def masks(radius: int) -> list[int]:
    """The covering masks, as signed 64-bit numbers."""
    vectors = (1 << (radius + 1)) - 1
    found = []
    for v in range(1, vectors + 1):
        mask = sum(1 << i for i in range(WIDTH) if bin(v & (1 + i % vectors)).count("1") & 1)
        found.append(mask - (1 << WIDTH) if mask >> (WIDTH - 1) else mask)
    return found


def shingles(text: str | None, size: int) -> Iterator[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if size == 3 and len(words) > 3:
        return map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    return (b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1) if words else 0))


def fingerprint(text: str | None, size: int) -> int:
    """The fingerprint as an unsigned number."""
    from xxhash import xxh64_intdigest

    sums, total, block = np.zeros(WIDTH, np.int64), 0, []

    def count() -> None:
        nonlocal total
        bits = np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums[:] += bits.sum(0, dtype=np.int64)
        total += len(block)
        block.clear()

    for shingle in shingles(text, size):
        block.append(xxh64_intdigest(shingle, SEED))
        if len(block) == BLOCK:
            count()
    if block:
        count()
    return int.from_bytes(np.packbits(2 * sums > total, bitorder="little").tobytes(), "little")


@cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    """The odd factors and the summands of the MinHash functions."""
    drawn = np.random.default_rng(SEED).integers(0, 1 << WIDTH, (2, BANDS * ROWS), np.uint64)
    return drawn[0] | np.uint64(1), drawn[1]


def band_keys(text: str | None, size: int = SIMILAR_WORDS) -> list[int]:
    """One signed key for each band: of the band and the least values of the text's shingles in it; none without words."""
    from xxhash import xxh64_intdigest

    factors, summands = _functions()
    least = np.full(BANDS * ROWS, (1 << WIDTH) - 1, np.uint64)
    own = shingles(text, size)
    any_found = False
    while block := [xxh64_intdigest(s, SEED) for s in islice(own, MIN_BLOCK)]:
        any_found = True
        np.minimum(least, (np.array(block, np.uint64)[:, None] * factors + summands).min(0), out=least)
    if not any_found:
        return []
    found = [xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.astype("<u8").reshape(BANDS, ROWS))]
    return [key - (1 << WIDTH) if key >> (WIDTH - 1) else key for key in found]


def _hashes(text: str | None, size: int = SIMILAR_WORDS) -> np.ndarray:
    """The hashes of the text's distinct shingles."""
    from xxhash import xxh64_intdigest

    return np.unique(np.fromiter((xxh64_intdigest(s, SEED) for s in shingles(text, size)), np.uint64))


def jaccard(left: str | None, right: str | None, size: int = SIMILAR_WORDS) -> float:
    a, b = set(shingles(left, size)), set(shingles(right, size))
    return len(a & b) / len(a | b) if a or b else 1.0


def _keyed(size: int, id_type: pa.DataType, similar: bool):
    schema = pa.schema([("doc_id", id_type), ("fp", pa.int64()), ("node", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in stream:
                for i in range(batch.num_rows):
                    doc, text, node = (batch.column(c)[i].as_py() for c in range(3))
                    fp = fingerprint(text, size)
                    yield doc, fp - (1 << WIDTH) if fp >> (WIDTH - 1) else fp, node, band_keys(text) if similar else []

        yield from batches(rows(), schema, lambda row: 64 + 8 * len(row[3]))

    return run


def _similar(similarity: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in stream:
                for i in range(batch.num_rows):
                    a, b, left, right = (batch.column(c)[i].as_py() for c in range(4))
                    if jaccard(left, right) >= similarity:
                        yield max(a, b), min(a, b)

        yield from batches(rows(), schema)

    return run


def _verified(candidates: DataFrame, texts: DataFrame, similarity: float, name: str) -> DataFrame:
    """A table of edges (a, b), a > b, of fingerprints; ``candidates``: (node, rep), ``texts``: (node, fp, text)."""
    left = candidates.join(texts.select("node", F.col("fp").alias("a"), F.col("text").alias("left")), "node")
    both = left.join(texts.select(F.col("node").alias("rep"), F.col("fp").alias("b"), F.col("text").alias("right")), "rep").where("a <> b")
    return written(both.select("a", "b", "left", "right").mapInArrow(_similar(similarity), "a long, b long").distinct(), name)


def _tally(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(BINS, np.int64)
    for batch in stream:
        texts = batch.column(0)
        for i in range(batch.num_rows):
            np.add.at(sums, (_hashes(texts[i].as_py()) & np.uint64(BINS - 1)).astype(np.int64), 1)
    found = np.flatnonzero(sums)
    yield pa.record_batch([pa.array(found), pa.array(sums[found])], schema=pa.schema([("bin", pa.int64()), ("n", pa.int64())]))


def prefix_lengths(n: int, similarity: float) -> tuple[int, int]:
    """Of n shingles in order, how many the first one shared with a text of any size lies in, and with one of n or more shingles."""
    return n - math.ceil(similarity * n - SLACK) + 1, n - math.ceil(2 * similarity / (1 + similarity) * n - SLACK) + 1


PREFIXES = "token long, node long, root long, size long, at long, indexed boolean"


def _prefixes(shared, similarity: float):
    kinds = [pa.int64()] * 5 + [pa.bool_()]
    schema = pa.schema([(column.split()[0], kind) for column, kind in zip(PREFIXES.split(", "), kinds, strict=True)])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value

        def rows() -> Iterator[tuple]:
            for batch in stream:
                for i in range(batch.num_rows):
                    node, root, text = (batch.column(c)[i].as_py() for c in range(3))
                    own = _hashes(text)
                    own = own[np.lexsort((own, counts[(own & np.uint64(BINS - 1)).astype(np.int64)]))]
                    probed, indexed = prefix_lengths(len(own), similarity)
                    for at, token in enumerate(own[:probed].view(np.int64).tolist()):
                        yield token, node, root, len(own), at, at < indexed

        yield from batches(rows(), schema)

    return run


def similar_pairs(opened: DataFrame, similarity: float) -> DataFrame:
    """Pairs (node, rep), node > rep, among which are all of different roots that reach the similarity; ``opened``: (node, root, text)."""
    counts = np.zeros(BINS, np.int64)
    tallied = opened.select("text").mapInArrow(_tally, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    counts[tallied["bin"].to_numpy()] = tallied["n"].to_numpy()
    shared = opened.sparkSession.sparkContext.broadcast(counts)
    tokens = written(opened.select("node", "root", "text").mapInArrow(_prefixes(shared, similarity), PREFIXES), "prefixes")
    shared.unpersist()
    # the group with most texts of a token never meets itself, so that the pairs looked at are at most twice those of different groups
    main = tokens.groupBy("token", "root").agg(F.count("*").alias("n")).groupBy("token").agg(F.count("*").alias("kinds"), F.max(F.struct("n", "root")).alias("main"))
    met = written(tokens.join(main.where("kinds > 1").select("token", F.col("main.root").alias("main")), "token"), "met-prefixes")
    x, y = met.where("root <> main").alias("x"), met.alias("y")
    size, other, at, other_at = (F.col(c) for c in ("x.size", "y.size", "x.at", "y.at"))
    # each pair once for a token; the lesser text's shingle is among its first ones; sizes, and shingles from here on, leave room for the similarity
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    first = F.when(size <= other, F.col("x.indexed")).otherwise(F.col("y.indexed"))
    alike = F.least(size, other) >= similarity * F.greatest(size, other) - SLACK
    room = F.least(size - at, other - other_at) >= similarity / (1 + similarity) * (size + other) - SLACK
    both = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & once & first & alike & room)
    found = written(both.select(F.greatest("x.node", "y.node").alias("node"), F.least("x.node", "y.node").alias("rep")).distinct(), "similar-pairs")
    dropped(tokens, met)
    return found


def similar_roots(docs: DataFrame, nodes: DataFrame, near: DataFrame, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(node, root) as of ``components``, of the edges ``near`` and those of fingerprints whose texts reach the similarity; ``nodes``: (node, fp, least_id, keys)."""
    # the key's last two bits, put over the node's first ones, pick the order of its bucket
    turn = F.shiftleft(F.col("key"), WIDTH - 2)
    keyed = nodes.select("node", F.explode("keys").alias("key")).withColumn("at", F.col("node").bitwiseXOR(turn))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")).where("lo < hi")
    crowded = written(crowded.select("key", "n", F.array(F.col("lo").bitwiseXOR(turn), F.col("hi").bitwiseXOR(turn)).alias("reps")), "crowded-bands")
    members = written(keyed.select("node", "key").join(crowded, "key"), "band-members")
    # the member that meets most others: what a family of near copies was made from meets nearly all of it
    meets = members.groupBy("node").agg(F.sum("n").alias("meets"))
    hubs = members.select("node", "key").join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", "node")).alias("hub"))
    hubs = written(hubs.select("key", F.col("hub.node").alias("hub")), "band-hubs")
    met = members.join(hubs, "key").select("node", F.explode(F.array_append("reps", F.col("hub"))).alias("rep")).where("node <> rep")
    candidates = written(met.select(F.greatest("node", "rep").alias("node"), F.least("node", "rep").alias("rep")).distinct(), "candidates")
    dropped(crowded, hubs)
    wanted = candidates.select("node").union(candidates.select("rep")).distinct()
    wanted = written(nodes.select("node", "fp", "least_id").join(wanted, "node"), "wanted")
    own = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text")).withColumn("own_node", F.xxhash64("text"))
    # the id deals copies of a text out, the node tells rows of one id apart; null ids match as well
    same = F.col("own_id").eqNullSafe(F.col("least_id")) & (F.col("own_node") == F.col("node"))
    texts = own.join(wanted.hint("shuffle_hash"), same).select("least_id", "node", "fp", "text").dropDuplicates(["least_id", "node"])
    texts = written(texts.select("node", "fp", "text"), "wanted-texts")
    similar = _verified(candidates, texts, similarity, "similar")
    roots = components(near.unionAll(similar).distinct())
    # larger buckets that are still of several groups: every pair of their texts in different groups that can reach the similarity
    rooted = wanted.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted-texts")
    large = written(members.where("n > 3").select("node", "key").join(rooted, "node"), "large-bands")
    several = large.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    opened = written(large.join(several, "key").select("node", "root").distinct(), "open-texts")
    dropped(wanted, members, similar, rooted, large)
    if not opened.isEmpty():
        pairs = similar_pairs(texts.join(opened, "node"), similarity)
        more = _verified(pairs.join(candidates, ["node", "rep"], "left_anti"), texts, similarity, "more-similar")
        if not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))
        dropped(pairs, more)
    dropped(candidates, texts, opened)
    return roots


def _printer(size: int, id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("fp", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((doc, fingerprint(text, size)) for doc, text in pairs(stream))
        yield from batches(((doc, fp - (1 << WIDTH) if fp >> (WIDTH - 1) else fp) for doc, fp in rows), schema)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    return docs.select(id_col, text_col).mapInArrow(_printer(shingle, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, fp long")


def _with_keys(docs: DataFrame, id_col: str, text_col: str, shingle: int, similar: bool) -> DataFrame:
    """(doc_id, fp, node, keys): the fingerprint, the digest that names the text, and the keys of its bands if asked for."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    own = docs.select(id_col, text_col, F.xxhash64(text_col).alias("node"))
    return own.mapInArrow(_keyed(shingle, to_arrow_type(kind), similar), f"doc_id {kind.simpleString()}, fp long, node long, keys array<long>")


def _flips(fp, mask: int, count: int):
    """All points within ``count`` bits of ``fp`` outside the mask."""
    outside = [i for i in range(WIDTH) if not mask >> i & 1]
    points = [0]
    for n in range(1, count + 1):
        points += [sum(1 << i for i in chosen) for chosen in combinations(outside, n)]
    signed = [p - (1 << WIDTH) if p >> (WIDTH - 1) else p for p in points]
    return F.transform(F.lit(signed), lambda p: fp.bitwiseXOR(p))


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b), a > b, whose components are those of all links among the distinct fingerprints ``fp``."""
    own = masks(radius)
    keyed = prints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(m) for m in own))).alias("t", "key"))
    # buckets with company; counted with map-side combining, joined back with skew handling
    crowded = keyed.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("t", "key")
    crowded = written(crowded, "crowded")
    members = keyed.join(crowded, ["t", "key"])
    half = radius // 2
    hub = F.lit(None)
    for t, mask in enumerate(own):
        near = _flips(F.col("fp"), mask & ((1 << WIDTH) - 1), half)
        hub = F.when(F.col("t") == t, near).otherwise(hub)
    met = members.select("fp", F.explode(hub).alias("hub")).distinct()
    if radius % 2:
        far = F.lit(None)
        for t, mask in enumerate(own):
            far = F.when(F.col("t") == t, _flips(F.col("fp"), mask & ((1 << WIDTH) - 1), half + 1)).otherwise(far)
        # a hub's near members on one side, all that reach it with one more flip on the other
        wide = members.select("fp", F.explode(far).alias("hub")).distinct()
        least = met.groupBy("hub").agg(F.min("fp").alias("b"))
        return wide.join(least, "hub").where("fp <> b").select(F.greatest("fp", "b").alias("a"), F.least("fp", "b").alias("b")).distinct()
    least = met.groupBy("hub").agg(F.min("fp").alias("b"), F.max("fp").alias("hi")).where("b < hi").select("hub", "b")
    return met.join(least, "hub").where("fp > b").select(F.col("fp").alias("a"), "b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each node's component, for every node of the edges (a, b) with a > b.

    Every table of a round goes once the next round's stands.
    """
    edges = written(edges, "links")
    for _ in range(rounds):
        # large star: every greater neighbour of a node goes to the least of its neighbourhood
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = written(least, "least-of-all")
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large-star")
        dropped(edges, least)
        # small star: a node and its lesser neighbours go to the least of these
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least-below")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        dropped(large, least)
        # stars only: no node is both a member and a centre, and no member has two centres
        state = small.agg(F.count("*").alias("n"), F.countDistinct("a").alias("members")).first()
        inner = small.select("b").distinct().join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        edges = small
        if state["n"] == state["members"] and not inner:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, similarity: float | None, by_text: bool) -> DataFrame:
    """(doc_id, fp, component_id), with ``by_text`` also the ``node`` that names the text, of every row."""
    if not by_text and similarity is None:
        prints = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    else:
        prints = written(_with_keys(docs, id_col, text_col, shingle, similarity is not None), "fingerprints")
    if similarity is None:
        distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
        roots = components(links(distinct.select("fp"), radius))
    else:
        nodes = written(prints.groupBy("node", "fp").agg(F.min("doc_id").alias("least_id"), F.max("keys").alias("keys")), "distinct-texts")
        distinct = written(nodes.groupBy("fp").agg(F.min("least_id").alias("least_id")), "distinct-fingerprints")
        roots = similar_roots(docs, nodes, links(distinct.select("fp"), radius), similarity, id_col, text_col)
        dropped(nodes)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    named = written(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "named-roots")
    members = written(rooted.select("fp", "root").join(named, "root").select("fp", "component_id", "root"), "named-fingerprints")
    dropped(distinct, rooted, named)
    return prints.join(members, "fp").select("doc_id", "fp", "component_id", *(["node", "root"] if by_text else []))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the least id that links lead to, the row's own included.

    ``similarity``: also link texts that share so much of their five-word shingles.
    """
    return _grouped(docs, id_col, text_col, shingle, radius, similarity, False)


def hexadecimal(fp):
    """Sixteen lowercase digits of a signed 64-bit fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group."""
    found = _grouped(docs, id_col, text_col, shingle, radius, similarity, True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "node"))
    kept_id, kept_node = free(docs.columns, "kept_id", "kept_node")
    kept = written(found.groupBy("root").agg(first.alias("first")).select(F.col("first.doc_id").alias(kept_id), F.col("first.node").alias(kept_node)), "kept-rows")
    # shuffled at every size: the kept rows grow with the documents, so they are never broadcast;
    # the text's digest is part of the key, so that rows without an id, or of one id, spread
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(kept_id)) & (F.xxhash64(text_col) == F.col(kept_node))
    return docs.join(kept.hint("shuffle_hash"), same, "left_semi").dropDuplicates([id_col, text_col])
