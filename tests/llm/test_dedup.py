import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from llm.helpers import awkward, frame, prose

import corpus_pipeline
from vecloom.llm import line_dedup, simhash, substring_dedup
from vecloom.llm.common import NULL_ID, public_id
from vecloom.llm.suffix_array import permuted_prefixes, suffix_array
import vecloom.llm.suffix_array as sa_module


def of(found, *columns):
    return sorted(map(tuple, found.select(*columns).collect()), key=repr)


def repeats(texts):
    first = {}
    data = [(NULL_ID if d is None else d, (t or "").encode()) for d, t in texts]
    for d, b in data:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        begins = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((d, len(b), int(gone.sum()), begins, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [0, 1 << 14])
def test_repeats(spark, hot):
    texts = awkward() + [(None, "copied " * 30)] * 40 + [(None, None)] * 30
    found = substring_dedup.remove_repeats(frame(spark, texts), hot=hot)
    want = repeats(texts)
    assert of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert any(w[2] for w in want)
    row = found.where("n_spans > 0").first()
    assert len(row.spans) == 2 * row.n_spans and sum(row.spans[1::2]) - sum(row.spans[::2]) == row.n_removed


def grouped(tables, by):
    """Tables by the value of a column."""
    out = {}
    for t in tables:
        for v in sorted(set(t.column(by).to_pylist())):
            out.setdefault(v, []).append(t.filter(pc.equal(t.column(by), v)))
    return {k: pa.concat_tables(v) for k, v in sorted(out.items())}


def in_turn(texts, job, blocks):
    """The steps of remove_repeats without Spark: the result, and how many bytes of stretches were sent."""
    rows = [(NULL_ID if d is None else d, xxhash.xxh64_intdigest((t or "").encode()) >> 1, t or "", k % blocks) for k, (d, t) in enumerate(texts)]
    table = pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("doc_id", pa.int64()), ("key", pa.int64()), ("text", pa.string()), ("block", pa.int32())))})
    by_block = grouped([table], "block")
    shared = grouped([job.shared(t) for t in grouped([job.anchors(t) for t in by_block.values()], "bucket").values()], "block")
    none = pa.table({"block": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "hashes": pa.array([], pa.binary()), "hot": pa.array([], pa.binary())})
    sent = [job.stretches(t, shared.get(b, none)) for b, t in by_block.items()]
    marks = [job.marks(t) for t in grouped(sent, "shard").values()]
    replies = grouped(marks, "block")
    empty = pa.table({"block": pa.array([], pa.int32()), "reply": pa.array([], pa.binary())})
    out = [job.remove(t, replies.get(b, empty)) for b, t in by_block.items()]
    got = pa.concat_tables(out).select(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return sorted(map(tuple, (r.values() for r in got.to_pylist())), key=repr), sum(len(x) for t in sent for x in substring_dedup.unpacked(t.column("text")))


@pytest.mark.parametrize("hot, slab", [(0, 300), (3, 2000), (1 << 14, 150)])
def test_repeats_in_slices(hot, slab, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 3000)
    monkeypatch.setattr(substring_dedup, "MERGED", 500)
    monkeypatch.setattr(substring_dedup, "SLAB", slab)
    monkeypatch.setattr(substring_dedup, "HELD", 40)
    texts = awkward()
    assert in_turn(texts, substring_dedup.Dedup(3, 50, 20, hot), 4)[0] == repeats(texts)


@pytest.mark.parametrize("hot", [10, 1 << 14])
def test_a_shared_line_is_sent_once_a_block(hot):
    line = "this line is in a third of all rows and so must not go to one task row by row"
    own = [" ".join(f"{n}w{k}" for k in range(8)) for n in range(300)]
    texts = [(n, own[n] + "\n" + line) for n in range(300)]
    assert in_turn(texts, substring_dedup.Dedup(3, 50, 20, hot), 2)[0] == repeats(texts)
    same = [(n, line) for n in range(300)]
    got, sent = in_turn(same, substring_dedup.Dedup(3, 50, 20, hot), 2)
    assert got == repeats(same) and sent == in_turn(same[:2], substring_dedup.Dedup(3, 50, 20, 0 if hot == 10 else hot), 2)[1]


def test_rows_between_blocks_and_shards_of_a_large_table(spark, monkeypatch):
    """Each block has a row for each shard: parts of one size would be 1,431 by 1,431 at 6 GB of text, 4 times that at 12 GB."""
    texts, seen = awkward(), {}
    plan, blocks, job = substring_dedup.plan, substring_dedup.in_blocks, substring_dedup.Dedup
    for total in (10**6, 6 * 10**9, 12 * 10**9):
        monkeypatch.setattr(substring_dedup, "plan", lambda rows: (total, *plan(rows)[1:]))
        monkeypatch.setattr(substring_dedup, "in_blocks", lambda rows, n: seen.update(blocks=n) or blocks(rows, min(n, 5)))
        monkeypatch.setattr(substring_dedup, "Dedup", lambda n, *how: seen.update(shards=n) or job(min(n, 7), *how))
        found = substring_dedup.remove_repeats(frame(spark, texts))
        assert seen["blocks"] * seen["shards"] <= max(1, total // 5000)
        assert -(-total // seen["blocks"]) <= 16 << 20 and -(-total // seen["shards"]) <= 8 << 20  # memory stays bounded
    assert of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats(texts)


def test_no_documents(spark):
    empty = frame(spark, [])
    for found in (substring_dedup.remove_repeats(empty), line_dedup.dedup_lines(empty), simhash.near_duplicates(empty), simhash.keep_first(empty)):
        assert found.count() == 0


def test_suffix_arrays(monkeypatch):
    rng = np.random.default_rng(3)
    for n in [1, 2, 3, 7, 40, 200]:
        for sigma in (1, 2, 4, 200):
            text = np.concatenate([rng.integers(1, sigma + 1, n), [0]]).astype(np.uint8)
            raw = text.tobytes()
            want = sorted(range(n + 1), key=lambda i: raw[i:])
            for small in (1 << 10, 0):  # by buckets, by sorting
                monkeypatch.setattr(sa_module, "SMALL", small)
                assert suffix_array(text).tolist() == want
            plcp = permuted_prefixes(text, np.array(want), 50)
            for i, j in zip(want, want[1:]):
                common = next(k for k in range(n + 1) if k == 50 or max(i, j) + k > n or raw[i + k] != raw[j + k])
                assert plcp[j] == common


def kept_lines(texts):
    first = {}
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\r\x0b\x0c"))
    data = [(NULL_ID if d is None else d, (t or "").split("\n")) for d, t in texts]
    for d, lines in data:
        for line in lines:
            first[key(line)] = min(first.get(key(line), d), d)
    out = []
    for d, lines in data:
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines(spark):
    texts = [*awkward(), (900, "é" * 9 + "\n" + "é" * 10), (901, "é" * 10 + "\n" + "é" * 9 + "\nsame same same\nSame SAME same  "), (902, "\r same same same\v")]
    texts += [(None, "one line of a row without id\nand another")] * 50
    found = line_dedup.dedup_lines(frame(spark, texts))
    want = kept_lines(texts)
    assert of(found, "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    assert sum(w[2] for w in want) > 10
    by_id = dict(texts)
    for r in found.where("doc_id in (901, 902)").collect():
        assert hashlib.sha256(line_dedup.kept_lines(by_id[r.doc_id], r.keep_bitmap).encode()).hexdigest() == r.kept_sha256


def test_lines_come_in_pieces_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PIECE", 10)
    for t in (b"", b"\n", b"a" * 35, b"a" * 35 + b"\n" + b"b" * 3, b"\n" * 25, b"ab\n" * 9, b"x" * 9 + b"\n" + b"y" * 10 + b"\n"):
        assert [x for p in line_dedup.pieces(np.frombuffer(t, np.uint8)) for x in p] == t.split(b"\n")
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 500).tolist() + [-(2**63), 2**63 - 1, 0, -1]
    rows = spark.createDataFrame([(x, 0, 0, 0, 0) for x in h], line_dedup.ENTRY)
    got = [[r.h1 for r in p] for p in line_dedup.in_ranges(rows, 5).rdd.glom().collect()]
    assert len(got) == 5 and [x for p in got for x in p] == sorted(h) and min(map(len, got)) > 50


def test_a_hash_that_goes_on_in_the_next_batch():
    entry = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["h1", "h2", "doc_id", "line", "block"])
    batches = [entry([(1, 1, 5, 0, 0), (1, 1, 7, 4, 1)]), entry([(1, 1, 9, 0, 2), (2, 0, 1, 1, 0)]), entry([(2, 0, 3, 9, 3)])]
    got = [tuple(r.values()) for b in line_dedup.stream(iter(batches)) for r in b.to_pylist()]
    assert got == [(1, 1, 1, 5), (2, 1, 1, 5), (3, 2, 0, 1)]


def brute_components(texts):
    prints = {}
    for k, (d, t) in enumerate(texts):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints[k] = sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    ids = [NULL_ID if d is None else d for d, _ in texts]
    least = {}
    for k in prints:
        least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return sorted(((ids[k], f"{prints[k]:016x}", least[find(k)]) for k in prints), key=repr)


@pytest.mark.parametrize("limit", [2048, 3])
def test_components(spark, limit, monkeypatch):
    texts = awkward()
    texts += [(2000 + k, t + " and more") for k, (_, t) in enumerate(texts) if t and len(t) > 150]
    monkeypatch.setattr(simhash, "LIMIT", limit)
    want = brute_components(texts)
    assert of(simhash.near_duplicates(frame(spark, texts)), "doc_id", "fingerprint", "component_id") == want
    assert len({w[2] for w in want}) < len({w[1] for w in want})


def test_links_of_planted_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64).tolist() + [0, -1, 1, 3, 7, 15, -(1 << 63)]
    points = {x: None for x in base}
    for x in base[:20]:
        y = x
        for b in rng.permutation(64)[: rng.integers(1, 6)]:
            y ^= 1 << int(b) if b < 63 else -(1 << 63)
        points[y] = None
    points = [(x, i) for i, x in enumerate(points)]
    monkeypatch.setattr(simhash, "LIMIT", 4)
    links = simhash.near_links(spark.createDataFrame(points, "print long, first long"))
    got = {r.node: r.root for r in simhash.components(links).collect()}
    label = np.arange(len(points))
    u = np.array([x for x, _ in points], np.int64).view(np.uint64)
    for _ in range(len(points)):
        for i in range(len(points)):
            label[i] = label[np.bitwise_count(u ^ u[i]) <= 3].min()
    assert {i: int(x) for i, x in enumerate(label) if x != i} == got


def test_chain_of_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)], "u long, v long")
    assert {r.node: r.root for r in simhash.components(links).collect()} == {i: 0 for i in range(1, 41)} | {101: 100, 103: 100}


def test_first_of_each_component_stays(spark):
    texts = awkward()
    docs = frame(spark, texts)
    kept = simhash.keep_first(docs, simhash.near_duplicates(docs))
    assert kept.columns == frame(spark, texts).columns
    components = {c for _, _, c in brute_components(texts)}
    assert sorted(NULL_ID if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(components)
    assert simhash.near_duplicates(frame(spark, texts)).select(public_id()).count() == len(texts)


def test_similar_texts_are_one_group(spark):
    import random

    r, base = random.Random(6), prose(21, 12, 400)
    base = [b + " " + " ".join(prose(40 + k, 12, 40)) for k, b in enumerate(base)]
    texts = [(10 * k, b) for k, b in enumerate(base)]
    for k, b in enumerate(base):
        w = b.split()
        for at in r.sample(range(len(w)), len(w) // 100):
            w[at] = "changed"
        texts += [(10 * k + 1, " ".join(w)), (10 * k + 2, b.upper().replace(" ", "  "))]
    got = {x.doc_id: x.component_id for x in simhash.similar(frame(spark, texts)).collect()}
    assert sum(got[10 * k + 1] == 10 * k for k in range(12)) >= 11 and all(got[10 * k + 2] == 10 * k == got[10 * k] for k in range(12))
    odd = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one")]
    got = {x.doc_id: x.component_id for x in simhash.similar(frame(spark, odd)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, NULL_ID: 4}
    assert simhash.similar(frame(spark, [])).count() == 0


def test_manhattan_distance_of_embeddings():
    r = np.random.default_rng(5)
    x, y = (r.integers(0, 2**63, 400, np.uint64) for _ in range(2))
    y[:200] = x[:200] ^ (np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64))
    counts = lambda v: (np.unpackbits(v.astype(">u8").view(np.uint8)).reshape(-1, 32, 2)).sum(axis=2).astype(int)
    got = np.bitwise_count(simhash.unary(x) ^ simhash.unary(y))
    assert (got == np.abs(counts(x) - counts(y)).sum(axis=1)).all() and (got <= np.bitwise_count(x ^ y)).all() and (got < np.bitwise_count(x ^ y)).any()


def test_shingles_of_pieces(monkeypatch):
    texts = [b"", b" ", b"a", b"a b", b"a B c", b"\x0ba\tb\n" * 9, b"word " * 40, b"x" * 90, b"x" * 90 + b" y z " * 9, *[x.encode() for x in prose(5, 30)]]
    for size in (3, 40, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE", size)
        for t in texts:
            assert b"".join(simhash.pieces(t)) == t
            for n in (1, 3, 5):
                w = t.lower().split()
                want = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))] if w else []
                assert simhash.shingle_hashes(t, n).tolist() == want
                bits = sum(1 << b for b in range(64) if want and 2 * sum(x >> b & 1 for x in want) > len(want))
                assert int.from_bytes(simhash.fingerprint(t, n)) == bits


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_similar(texts):
    """The component of each row by comparing all pairs of sets of shingles."""
    split = lambda t: (t or "").lower().split()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := split(t)) else set() for _, t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    return {frozenset(i for i in range(len(texts)) if root[i] == x) for x in set(root)}


def test_similar_against_all_pairs(spark):
    r, base = random.Random(4), prose(90, 12, 120)
    texts = list(enumerate(base)) + [(None, None), (None, ""), (None, base[0]), (None, base[1] + " more"), (3, base[5]), (3, base[6].upper())]
    for k in range(60):
        w = r.choice(base).split()
        at, n = r.randrange(len(w)), r.randint(0, max(1, len(w) // 9))
        texts.append((100 + k, " ".join(w[:at] + ["new"] * r.randint(0, 3) + w[at + n :])))
    found = simhash.similar(frame(spark, texts)).collect()
    keys = {(x.doc_id, x.key): (x.component_id, x.component_key) for x in found}
    key_of = {r.text: r.k for r in spark.createDataFrame([(t or "",) for _, t in texts], "text string").selectExpr("text", "xxhash64(text) k").collect()}
    groups = {}
    for i, (d, t) in enumerate(texts):
        groups.setdefault(keys[NULL_ID if d is None else d, key_of[t or ""]], set()).add(i)
    assert len(found) == len(texts) and set(map(frozenset, groups.values())) == brute_similar(texts)


def five_words(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_contiguous_edits_at_the_limit(spark):
    r, texts, pairs = random.Random(8), [], {}
    for k in range(40):
        word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
        w = [word() for _ in range(204)]  # 200 shingles; 50 more: 200 / 250 = 0.8, one more: below
        over = k % 2
        other = w + [word() for _ in range(50 + over)]
        texts += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(other))]
        a, b = five_words(texts[-2][1]), five_words(texts[-1][1])
        pairs[k] = len(a & b) / len(a | b) >= 0.8
        assert pairs[k] == (not over)
    got = {x.doc_id: x.component_id for x in simhash.similar(frame(spark, texts)).collect()}
    assert {k: got[10 * k + 1] == got[10 * k] for k in pairs} == pairs


def test_pairs_of_one_band_that_its_first_does_not_link(spark, monkeypatch):
    w = [f"w{i}" for i in range(1000)]
    texts = [(1, w[:600] + w[800:]), (2, w[:800]), (3, w[:810]), (4, w[100:600] + w[800:])]
    monkeypatch.setattr(simhash, "band_keys", lambda least: list(range(simhash.BANDS)))
    monkeypatch.setattr(simhash, "BLOCK", 2)
    got = {x.doc_id: x.component_id for x in simhash.similar(frame(spark, [(d, " ".join(x)) for d, x in texts])).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 1}


def test_different_texts_of_one_id_all_stay(spark):
    a, b, c, d = (" ".join(prose(60 + k, 4, 100)) for k in range(4))
    texts = [(None, a), (None, b), (None, c), (5, a), (7, b), (7, d), (2, d.upper()), (None, None), (8, a + " end"), (None, b + " end")]
    kept = corpus_pipeline.distinct(spark, frame(spark, texts), "")
    want = [(5, a), (7, b), (None, c), (2, d.upper()), (None, None)]
    assert sorted(map(tuple, kept.select("doc_id", "text").collect()), key=repr) == sorted(want, key=repr)


def test_links_of_one_text_are_not_those_of_another_with_its_id(spark):
    a, b = (" ".join(prose(70 + k, 4, 100)) for k in range(2))
    bits = lambda x, y: (int.from_bytes(simhash.fingerprint(x.encode())) ^ int.from_bytes(simhash.fingerprint(y.encode()))).bit_count()
    near = next(t for t in (f"{a} end {k}" for k in range(500)) if 1 <= bits(a, t) <= 3)
    got = of(simhash.near_duplicates(frame(spark, [(None, a), (None, b), (2, near)])), "doc_id", "component_id")
    assert bits(a, b) > 3 and got == [(2, 2), (NULL_ID, 2), (NULL_ID, NULL_ID)]


def test_cells_that_stay_large_are_compared_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    prints = np.unique(rng.integers(0, 1 << 63, 30)[:, None] ^ (np.int64(1) << rng.integers(0, 40, (30, 3)))).tolist()
    points = [(x, i) for i, x in enumerate(prints)]
    for name, value in (("LIMIT", 0), ("LEVELS", 1), ("BLOCK", 2), ("STRIPE", 2)):
        monkeypatch.setattr(simhash, name, value)
    got = {r.node: r.root for r in simhash.components(simhash.near_links(spark.createDataFrame(points, "print long, first long"))).collect()}
    u, label = np.array(prints, np.int64).view(np.uint64), np.arange(len(prints))
    for _ in range(len(prints)):
        label = np.array([label[np.bitwise_count(u ^ x) <= 3].min() for x in u])
    assert {i: int(x) for i, x in enumerate(label) if x != i} == got and got


def test_a_large_cell_takes_little_memory():
    import tracemalloc

    tracemalloc.start()
    base = np.random.default_rng(5).integers(0, 1 << 63, dtype=np.uint64)
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    prints = np.unique(base ^ one[:, None, None] ^ one[None, :, None] ^ one[None, None, :16])[:6000]
    x, y = simhash.forest(prints, np.arange(len(prints)), 3)
    assert len(x) == len(prints) - 1 and (y == 0).all() and tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
