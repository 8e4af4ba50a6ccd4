"""SimHash near-duplicates: segment popcounts, a grid range-join under Manhattan distance, exact verification.

The 64 bits of a fingerprint are cut in segments; its embedding holds how many bits each segment has set. The
Manhattan distance of two embeddings is never above their fingerprints' Hamming distance. Cut the embedding
in four parts: within distance three, one part at least doesn't differ, so the grid cells are the values of a
part, and every pair within three shares a cell. A cell with more than LIMIT fingerprints is cut again: what
is left of the fingerprint is in four parts, of one-bit segments (whose Manhattan distance is the Hamming
distance), one of which doesn't differ either. In a cell the Manhattan distance of the whole embeddings rules
pairs out, what is left is verified by all bits. A cell gives a spanning forest of its links, never all pairs.

similar() decides by the shingles' Jaccard similarity. Fingerprints within three bits are too few candidates for
that (a pair at 0.8 has a chance below 0.01), so minima of the shingles' hashes (MinHash) add to them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import NULL_ID, ends, keyed, settle, shuffle_partitions, slabs, strings

BITS, DISTANCE, PARTS, LIMIT = 64, 3, 4, 2048
LEVELS, BLOCK, STRIPE = 4, 8192, 128
SHINGLES, PIECE, SPACE = 1 << 16, 1 << 20, re.compile(rb"[ \t\n\r\x0b\x0c]")
BANDS, ROWS, SURE = 24, 5, 3.3
LINK = "struct<doc_id: bigint, key: bigint>"
#: What each of the minima mixes the shingles' hashes with: a mask and an odd factor.
MIX = np.random.default_rng(42).integers(0, 1 << 64, (BANDS * ROWS, 2), np.uint64) | np.array([0, 1], np.uint64)


def pieces(text: bytes) -> Iterator[bytes]:
    """A text cut at white space, PIECE bytes or little more at a time."""
    i = 0
    while len(text) - i > 2 * PIECE and (found := SPACE.search(text, i + PIECE)):
        yield text[i : found.start()]
        i = found.start()
    yield text[i:] if i else text


def shingles(text: bytes, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """The XXH64 of a text's shingles, repeats included, piece by piece. Fewer words than a shingle: the whole sequence; no words: none."""
    left: list[bytes] = []
    digest, some = xxhash.xxh64_intdigest, False
    for last, piece in ends(pieces(text)):
        found = left + (piece or b"").lower().split()
        left = found
        if last and (some or not found) or not last and len(found) < words:
            continue
        joined, size = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
        start = np.cumsum(size + 1) - size - 1
        k = max(1, len(found) - words + 1)
        begin, end = start[:k].tolist(), (start + size)[min(words, len(found)) - 1 :].tolist()
        yield np.fromiter((digest(joined[a:b], seed) for a, b in zip(begin, end, strict=True)), np.uint64, k)
        left, some = found[k:], True


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> bytes:
    """8 bytes, the highest bit first: those that over half the shingles' hashes have."""
    return print_of(shingles(text, words, seed))


def print_of(hashes: Iterator[np.ndarray]) -> bytes:
    count, n = np.zeros(BITS, np.int64), 0
    for h in hashes:
        for i in range(0, len(h), SHINGLES):
            count += bit_counts(h[i : i + SHINGLES].astype(">u8").view(np.uint8))
        n += len(h)
    return np.packbits(2 * count > n).tobytes()


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of these 8-byte hashes have each bit."""
    bits = np.unpackbits(hashes).reshape(-1, BITS)
    full = len(bits) // 255 * 255
    return bits[:full].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[full:].sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id (null: the largest), key (tells rows of one doc_id apart) and the fingerprint of each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = strings(b.column(2))
            prints = b"".join(fingerprint(data[i:j].tobytes(), words, seed) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.frombuffer(prints, ">u8").astype(np.uint64).view(np.int64))], ["doc_id", "key", "print"])

    return keyed(docs).select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(of, "doc_id long, key long, print long")


def parts(bits: list[int]) -> list[list[int]]:
    """Four runs of nearly the same length."""
    return [x.tolist() for x in np.array_split(np.array(bits), PARTS)]


def cell(name: str, bits: list[int], width: int) -> Column:
    """The embedding of these bits, in segments of `width`, as one number."""
    base = width + 1
    segments = [bits[i : i + width] for i in range(0, len(bits), width)]
    terms = [F.bit_count(F.col(name).bitwiseAND(F.lit(sum(1 << b for b in s) - (1 << 64) * (63 in s)))).cast("long") * F.lit(base**k) for k, s in enumerate(segments)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def unary(prints: np.ndarray) -> np.ndarray:
    """Embeddings in segments of two bits, each count (0 to 2) in unary: the bits in which two differ are their Manhattan distance."""
    odd, one = np.uint64(0x5555555555555555), np.uint64(1)
    return ((prints & (prints >> one) & odd) << one) | ((prints | (prints >> one)) & odd)


def forest(prints: np.ndarray, ids: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among these fingerprints, in stripes of rows; no matrix of all pairs is made.

    Pairs within the distance by the embeddings' Manhattan distance, a lower bound, are verified by their bits.
    """
    order = np.argsort(ids, kind="stable")
    prints, ids = prints[order], ids[order]
    embedded, label, none = unary(prints), np.arange(len(ids)), len(ids)
    for i in range(0, len(ids), STRIPE):
        near = np.bitwise_count(embedded[i : i + STRIPE, None] ^ embedded[None, :]) <= distance
        a, b = np.nonzero(near)
        near[a, b] = np.bitwise_count(prints[i + a] ^ prints[b]) <= distance
        near = near[near.sum(axis=1) > 1]
        while len(near):
            row = np.where(near, label, none).min(axis=1)
            column = np.minimum(label, np.where(near, row[:, None], none).min(axis=0))
            if (column == label).all():
                break
            root = np.arange(none)
            np.minimum.at(root, label, column)
            while (root[root] != root).any():
                root = root[root]
            label = root[label]
    other = label != np.arange(none)
    return ids[other], ids[label[other]]


def leaves(distance: int):
    """Compare the cells of a partition that is sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for last, b in ends(batches):
            if b is not None and b.num_rows:
                t = [np.array(b.column(k).to_numpy(zero_copy_only=False)) for k in range(3)]
                kept = t if kept is None else [np.concatenate(x) for x in zip(kept, t, strict=True)]
            if kept is None:
                continue
            edge = np.concatenate([[0], np.flatnonzero(np.diff(kept[0])) + 1, [len(kept[0])]])
            whole = len(edge) - 1 if last else len(edge) - 2
            one, two = [], []
            for i, j in zip(edge[:whole], edge[1 : whole + 1], strict=True):
                if j - i > 1:
                    x, y = forest(kept[1][i:j].view(np.uint64), kept[2][i:j], distance)
                    one.append(x)
                    two.append(y)
            kept = [x[edge[whole] :] for x in kept]
            if one and sum(map(len, one)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one)), pa.array(np.concatenate(two))], ["u", "v"])

    return run


def blocks(cells: DataFrame, counts: DataFrame, by: str = "print") -> DataFrame:
    """Cells of over BLOCK rows as cells of each two of their blocks (by a hash of a column); smaller ones as they are."""
    large = settle(counts.where(F.col("count") > BLOCK))
    if large.isEmpty():
        return cells
    many = F.ceil(F.col("count") / BLOCK).cast("int")
    dealt = cells.join(large, "cell").withColumn("many", many).withColumn("b", F.pmod(F.xxhash64(by), "many").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    pair = F.xxhash64("cell", F.least("b", "other"), F.greatest("b", "other")).alias("cell")
    columns = [c for c in cells.columns if c != "cell"]
    return cells.join(large, "cell", "left_anti").select("cell", *columns).unionByName(dealt.select(pair, *columns))


def near_links(points: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """u, v: links between fingerprints, named by `first`, that connect all within the distance.

    points: `print` and `first`, each first once. Cells are cut again while any holds more than LIMIT, up to
    LEVELS times; what is still larger than BLOCK is dealt into blocks, and each two of them are compared in a task's cell.
    """
    if distance >= PARTS:
        raise ValueError(f"{PARTS} parts allow a distance below {PARTS}")
    n = shuffle_partitions(points.sparkSession)
    out, level = None, 0
    tracks = {(): list(range(BITS))}  # the parts taken so far: the bits that are left
    heavy = points.withColumns({"cell": F.lit(0).cast("long"), "track": F.lit(0)})
    while True:
        width, names, rows = 2 if level == 0 else 1, {}, []
        for at, (track, left) in enumerate(tracks.items()):
            for k, part in enumerate(parts(left)):
                names[(*track, k)] = [b for b in left if b not in part]
                rows.append(F.when(F.col("track") == at, F.struct(F.lit(at * PARTS + k).alias("track"), F.xxhash64("cell", F.lit(k), cell("print", part, width)).alias("cell"))))
        cut = heavy.select("print", "first", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x")).select("x.cell", "print", "first", "x.track")
        tracks, level = names, level + 1
        counts = cut.groupBy("cell").count()
        large = settle(counts.where(F.col("count") > LIMIT).select("cell")) if level < LEVELS else None
        any_large = large is not None and not large.isEmpty()
        small = cut.join(large, "cell", "left_anti") if any_large else cut
        if level == LEVELS:
            small = blocks(small.select("cell", "print", "first"), counts)
        found = small.select("cell", "print", "first").repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(leaves(distance), "u long, v long")
        out = found if out is None else out.unionByName(found)
        if not any_large:
            return out.distinct()
        heavy = cut.join(large, "cell", "left_semi").select("print", "first", "cell", "track")


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each linked node reaches, by alternating large and small stars."""
    edges, before = settle(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = settle(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = DISTANCE, seed: int = 42) -> DataFrame:
    """doc_id, key, fingerprint and component_id of each row.

    A fingerprint's bit is set if over half the XXH64 of the text's shingles have it; fewer words than a
    shingle: the whole sequence; none (empty or null text): zero, linked like any other. Rows with one
    fingerprint are one node, so copies cost nothing. Null doc_id: the largest id. Empty table: no rows.
    """
    prints = settle(fingerprints(docs, words, seed))
    points = settle(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(points.select("print", F.col("print").alias("first")), distance))
    rooted = settle(points.join(roots, points["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", "key", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """shingles() as one array."""
    return np.concatenate([np.zeros(0, np.uint64), *shingles(text, words, seed)])


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of a set's hashes under each of BANDS * ROWS mixings."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 1024):
        g = (shingles[None, i : i + 1024] ^ MIX[:, :1]) * MIX[:, 1:]
        least = np.minimum(least, (g ^ (g >> np.uint64(32))).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """A hash of each band's ROWS minima. Sets alike to J share a band's with chance J ** ROWS."""
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[8 * ROWS * k : 8 * ROWS * (k + 1)], k) for k in range(BANDS)]


def lists(rows: list[np.ndarray]) -> pa.Array:
    """Arrays of unsigned numbers as one column of lists."""
    flat = np.concatenate([*rows, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat))


SKETCH = "doc_id long, key long, s1 long, s2 long, n long, bands array<long>, print long, marks binary"


def sketches(words: int):
    """Of each text: two hashes and the size of its set of shingles, its bands, its fingerprint, and a byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = strings(b.column(2))
            names, size, bands, prints, marks = [], [], [], [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                h = shingle_hashes(data[i:j].tobytes(), words)
                x = np.unique(h)
                least = minima(x)
                names.append(xxhash.xxh3_128_digest(x.tobytes()))
                size.append(len(x))
                bands.append(np.array(band_keys(least) if len(x) else [], np.uint64))
                prints.append(int.from_bytes(print_of([h]), signed=True))
                marks.append(least.astype(np.uint8).tobytes())
            s = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy()), pa.array(size, pa.int64()), lists(bands), pa.array(prints, pa.int64()), pa.array(marks, pa.binary())],
                [x.split()[0] for x in SKETCH.split(", ")],
            )

    return run


def sets_of(words: int):
    """The set of shingles of each text, in batches of about 4 MB of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = strings(b.column(2))
            for i, j in slabs(at, 4 << 20):
                rows = [np.unique(shingle_hashes(data[x:y].tobytes(), words)) for x, y in zip(at[i:j].tolist(), at[i + 1 : j + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), lists(rows)], ["doc_id", "key", "shingles"])

    return run


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs u, v whose sets have this Jaccard similarity, counted exactly."""
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"{x}_set")) for x in "uv")
    common = F.size(F.array_intersect("u_set", "v_set"))
    return pairs.join(a, "u").join(b, "v").where(common / (F.size("u_set") + F.size("v_set") - common) >= similarity).select("u", "v")


def likely(similarity: float):
    """Pairs of a partition's nodes, sorted by cell, that are of one cell and different roots, and have nearly as many
    minima in common as sets of this similarity: `SURE` standard deviations less at most. Stripes of rows are compared."""
    all_ = BANDS * ROWS
    least = all_ * similarity - SURE * (all_ * similarity * (1 - similarity)) ** 0.5

    def pairs(node: pa.Array, root: np.ndarray, n: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        common = np.bincount(root).argmax()  # its nodes are compared with the others' only
        others = np.flatnonzero(root != common)
        for i in range(0, len(others), STRIPE):
            rows = others[i : i + STRIPE]
            same = np.zeros((len(rows), len(root)), np.uint8)
            for k in range(all_):
                same += marks[rows, k, None] == marks[None, :, k]
            mine = root[rows, None]
            a, b = np.nonzero((same >= least) & (mine != root) & ((root == common) | (mine < root)))
            a = rows[a]
            alike_ = np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9
            if alike_.any():
                yield pa.RecordBatch.from_arrays([node.take(pa.array(a[alike_])), node.take(pa.array(b[alike_]))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for last, b in ends(batches):
            if b is not None and b.num_rows:
                t = pa.Table.from_batches([b])
                kept = t if kept is None or not len(kept) else pa.concat_tables([kept, t])
            if kept is None or not len(kept):
                continue
            cell_ = np.asarray(kept.column("cell"))
            edge = np.concatenate([[0], np.flatnonzero(np.diff(cell_)) + 1, [len(cell_)]])
            whole = len(edge) - 1 if last else len(edge) - 2
            for i, j in zip(edge[:whole].tolist(), edge[1 : whole + 1].tolist(), strict=True):
                part = kept.slice(i, j - i).combine_chunks()
                root = np.unique(np.asarray(part.column("root")), return_inverse=True)[1]
                marks = np.frombuffer(b"".join(part.column("marks").to_pylist()), np.uint8).reshape(j - i, all_)
                yield from pairs(part.column("node").combine_chunks(), root, np.asarray(part.column("n")), marks)
            kept = kept.slice(int(edge[whole]))

    return run


def similar(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """doc_id, key, component_id and component_key of each row, for texts whose shingles of `words` words are `similarity` alike (Jaccard).

    Texts with one set of shingles are one node, named by the least (doc_id, key). Candidates have fingerprints
    within DISTANCE bits, or share one of BANDS bands of ROWS minima; whatever the edit, a pair at 0.8 shares no band
    with chance (1 - 0.8 ** 5) ** 24, under 1 in 10,000. Each candidate pair is compared by its sets of shingles (as
    64-bit hashes): first the links of fingerprints, and each band's first node with its others. Where these leave a
    band's nodes in several components, those of different ones are candidates if enough of their minima are the
    same (likely(); a pair at 0.8 fails that with chance under 1 in 1,000). No estimate makes a link.
    Component: the least (doc_id, key) in it. Texts without words are alike. Null doc_id: the largest id. Empty table: no rows.
    """
    rows = keyed(docs).select("doc_id", F.xxhash64("text").alias("key"), "text")
    prints = settle(rows.mapInArrow(sketches(words), SKETCH))
    name = F.struct("doc_id", "key")
    nodes = settle(prints.groupBy("s1", "s2").agg(F.min(name).alias("node"), *[F.first(c).alias(c) for c in ("n", "bands", "print", "marks")]))
    cells = nodes.select("node", "n", F.explode("bands").alias("h"))
    firsts = cells.groupBy("h").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("members")).where("members > 1")  # no window: a band may hold many
    cells = settle(cells.join(firsts.drop("members"), "h"))

    def sized(a: str, b: str) -> Column:  # sets of other sizes can't be so alike
        return F.least(a, b) / F.greatest(a, b) >= similarity

    points = settle(nodes.where("n > 0").groupBy("print").agg(F.min(F.struct("node", "n")).alias("least")))
    near = near_links(points.select("print", F.col("print").alias("first")))
    a, b = (points.select(F.col("print").alias(x), F.col("least").alias(f"{x}_least")) for x in "uv")
    stars = [
        near.join(a, "u").join(b, "v").select(F.col("u_least").alias("first"), F.col("v_least.node").alias("node"), F.col("v_least.n").alias("n")),
        nodes.where("n > 0").join(points, "print").select(F.col("least").alias("first"), "node", "n"),
        cells.select("first", "node", "n"),
    ]
    tried = stars[0].unionByName(stars[1]).unionByName(stars[2]).where(F.col("node") != F.col("first.node")).where(sized("first.n", "n"))
    tried = settle(tried.select(F.least("first.node", "node").alias("u"), F.greatest("first.node", "node").alias("v")).distinct())
    some = cells.select("node").unionByName(tried.select(F.col("u").alias("node"))).unionByName(tried.select(F.col("v").alias("node"))).select("node.*").distinct()
    texts = rows.join(some, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
    sets = settle(texts.mapInArrow(sets_of(words), "doc_id long, key long, shingles array<long>").select(name.alias("node"), "shingles"))
    links = settle(alike(tried, sets, similarity))
    roots = components(links)

    joined = cells.join(roots, "node", "left").select("h", "node", "n", F.coalesce("root", "node").alias("root"))
    apart = joined.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("count")).where("x <> y").select(F.col("h").alias("cell"), "count")
    left = settle(joined.withColumnRenamed("h", "cell").join(apart, "cell").join(nodes.select("node", "marks"), "node").select("cell", "node", "n", F.xxhash64("root").alias("root"), "marks", "count"))
    dealt = blocks(left.drop("count"), left.select("cell", "count").distinct(), "node")
    rest = dealt.repartition(shuffle_partitions(docs.sparkSession), "cell").sortWithinPartitions("cell").mapInArrow(likely(similarity), f"u {LINK}, v {LINK}")
    rest = rest.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    more = settle(alike(settle(rest.join(tried, ["u", "v"], "left_anti")), sets, similarity))
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    named = nodes.join(roots, "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("root"))
    return prints.join(named, ["s1", "s2"]).select("doc_id", "key", F.col("root.doc_id").alias("component_id"), F.col("root.key").alias("component_key"))


def keep_first(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The rows of docs, all columns, that are the first of their component (by id, then a hash of the text); of rows with one id and text, one.

    groups: of each row doc_id, key, component_id and, where components of one id are told apart, component_key
    (near_duplicates, without it, or similar); by default similar(docs).
    """
    groups = similar(docs) if groups is None else groups
    first = groups.groupBy(*[c for c in ("component_id", "component_key") if c in groups.columns]).agg(F.min(F.struct("doc_id", "key")).alias("x")).select(F.col("x.doc_id").alias("kept_id"), F.col("x.key").alias("kept_key"))
    columns = docs.columns
    own = docs.select(
        F.struct(*columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("kept_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("kept_key"),
    )
    return own.join(first, ["kept_id", "kept_key"], "left_semi").dropDuplicates(["kept_id", "kept_key"]).select("row.*")
