import random

import numpy as np
from llm.helpers import awkward, frame, prose
from pyspark.sql import functions as F

from vecloom.llm import quality, toxicity


def labelled(spark, n=240):
    good = prose(3, n, 80)
    texts = [(i, x if i % 3 else " | ".join(x.upper().split()) + " !!") for i, x in enumerate(good)]
    return texts, spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(n)] + [(None, 1, None), (5000, None, 1)], "doc_id long, quality int, toxic int")


def test_network_learns_and_scores_whole_texts(spark):
    texts, labels = labelled(spark)
    docs = frame(spark, [*texts, *[(d, t) for d, t in awkward() if d is None or d >= 0]])
    net = quality.fit(frame(spark, texts), labels, "quality", quality.fold(3) != 1)
    scores = quality.score(docs, net)
    assert scores.count() == docs.count() and scores.where("score is null or not score between 0 and 1").count() == 0
    got = {r.doc_id: r.score for r in quality.score(frame(spark, texts), net).collect()}
    held = [i for i in got if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 40 and np.mean([(got[i] >= 0.5) == (i % 3 > 0) for i in held]) > 0.95
    kept = quality.keep_good(docs, net)
    assert kept.columns == docs.columns and kept.count() == scores.where("score >= 0.5").count()


def plain_score(net, text):
    """The network's probability by loops over chunks, places and filters."""
    c, step, w = quality.CHUNK, quality.STEP, quality.WIDTH
    starts = [0]
    while starts[-1] + c < len(text):
        starts.append(starts[-1] + step)
    units = []
    for a in starts:
        part = text[a : a + c].ljust(c, b"\0")
        best = np.full(quality.FILTERS, -np.inf)
        for i in range(0, c - w + 1, 2):
            x = np.concatenate([net.emb[b] for b in part[i : i + w]])
            best = np.maximum(best, sum(x[2 * quality.DIM * s : 2 * quality.DIM * (s + 1)] @ net.conv[s] for s in range(w // 2)))
        units.append(np.maximum(np.maximum(best + net.bias, 0) @ net.w1 + net.b1, 0))
    z = np.concatenate([np.max(units, axis=0), np.mean(units, axis=0)]) @ net.w2 + net.b2
    return float(1 / (1 + np.exp(-z[0])))


def test_forward_pass_against_loops():
    net = quality.Network.new(3)
    texts = [b"", b"a", b"x" * 255, b"y" * 256, b"z" * 257, *[t.encode() for t in prose(4, 6, 200)], bytes(range(1, 256)) * 4]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = net.scores(np.frombuffer(b"".join(texts), np.uint8), at)
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-5) and got.std() > 0


def test_chunks_cover_all_bytes():
    data = np.arange(2000, dtype=np.int64).astype(np.uint8)
    at = np.array([0, 0, 1, 256, 257 + 256, 2000])
    some, head = quality.chunks(data, at)
    assert len(head) == 5 and head[0] == 0 and not some[0].any()
    for k, (i, j) in enumerate(zip(at, at[1:])):
        mine = some[head[k] : (head[k + 1] if k < 4 else len(some))]
        covered = {i + c * quality.STEP + p for c in range(len(mine)) for p in range(quality.CHUNK)}
        assert set(range(i, j)) <= covered
        joined = np.concatenate([m[: quality.STEP] for m in mine[:-1]] + [mine[-1]])[: j - i]
        assert (joined == data[i:j]).all()


def test_gradients():
    rng = np.random.default_rng(0)
    net = quality.Network.new(1)
    for name in net.__dataclass_fields__:
        setattr(net, name, getattr(net, name).astype(np.float64))
    data = rng.integers(97, 122, 900).astype(np.uint8)
    some, head = quality.chunks(data, np.array([0, 300, 900]))
    y, w = np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss():
        z = net.combine(net.features(net.pooled(some)[1]), head).astype(np.float64) @ net.w2 + net.b2
        p = 1 / (1 + np.exp(-z))
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    grads = dict(zip(net.__dataclass_fields__, net.step(some, head, y, w)))
    for name in net.__dataclass_fields__:
        value = getattr(net, name)
        for k in np.argsort(-np.abs(grads[name]).ravel())[:3]:
            at = np.unravel_index(k, value.shape)
            old = value[at]
            value[at] = old + 1e-3
            up = loss()
            value[at] = old - 1e-3
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-3 - grads[name][at]) < 5e-3 + 0.1 * abs(grads[name][at]), name


def test_sample_is_bounded(spark):
    texts = [(k, f"text {k} " * (k + 1)) for k in range(60)] + [(7, f"another {k}") for k in range(30)] + [(8, None), (9, "x" * 3000), (None, "no id")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(7, 1), (None, 1), (500, 0), (3, None)], "doc_id long, y int")
    usable = F.col("doc_id") != 4
    got, y, prior = quality.sample(frame(spark, texts), labels, "y", usable, 40, 4000)
    assert len(got) == len(y) <= 40 and sum(len(x) for x, v in zip(got, y) if v == 0) <= 2000 and {0.0, 1.0} == set(y.tolist())
    assert sum(x.startswith(b"another") or x.startswith(b"text 7 ") for x in got) <= 1 and not any(x.startswith(b"text 4 ") for x in got)
    assert prior == 31 / 61
    again = quality.sample(frame(spark, texts[::-1]), labels, "y", usable, 40, 4000)
    assert again[0] == got and (again[1] == y).all()


def test_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, awkward())
    assert quality.score(docs, quality.fit(docs, none)).count() == docs.count()
    assert toxicity.score(docs, toxicity.fit(docs, none)).where("score = 0.5").count() == docs.count()
    assert toxicity.score(frame(spark, []), toxicity.fit(frame(spark, []), none)).count() == 0


BAD = ["moron", "idiot", "stupid", "trash"]


def toxic_docs(n=300):
    out = []
    for i, x in enumerate(prose(9, n, 60)):
        words = x.split()
        if i % 4 == 0:
            for j in range(2):
                words.insert((7 * i + j) % (len(words) + 1), BAD[(i // 4 + j) % 4])
        out.append((i, " ".join(words)))
    return out


def test_toxicity_learns_and_restores(spark, monkeypatch):
    texts = toxic_docs()
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in texts], "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame(spark, texts), labels, quality.fold(4) != 2)
    assert set(BAD) <= set(model.restorer.lexicon)
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, texts), model).collect()}
    assert np.mean([(s >= 0.3) == (i % 4 == 0) for i, s in got.items()]) > 0.97
    clean = texts[1][1]
    for word in ("m0r0n", "1d10t", "IDIOT!!", "i d i o t", "s.t.u.p.i.d", "stuuupid", "$tupid", "tr@sh", "id-iot", "mooron", "m*ron", "i d i o t.", '"i d i o t"', "m o ron", "st upid", "tra$h!", "stupi*", "idi*t", "1d107"):
        assert model.score(f"{clean} {word} {clean}") >= 0.3, word
    for text in ("", "   ", clean, "a@b.example 4111111111111111 | | |", "****** *.*.* ***" * 3, "idle stump tray more on"):
        assert model.score(text) < 0.3, text
    monkeypatch.setattr(toxicity, "CHUNK", 40)
    long = f"{clean} st upid {clean} m0r0n {clean} i d i o t " * 3
    n, hits = model.restorer.hits(long)
    monkeypatch.setattr(toxicity, "CHUNK", 1 << 20)
    assert (n, sorted(hits)) == (lambda x: (x[0], sorted(x[1])))(model.restorer.hits(long)) and hits.count("stupid") == hits.count("moron") == hits.count("idiot") == 3


def all_paths(token):
    """What a lattice can spell, and the channel's log probability of it."""
    out = {"": 0.0}
    for some in toxicity.options(token):
        new = {}
        for text, p in out.items():
            for x, q in some:
                new[text + x] = max(new.get(text + x, -1e9), p + q)
        out = new
    return out


def test_decoding_against_all_paths():
    lexicon = {"moron": 5.0, "idiot": 5.0, "loser": 4.0, "trash": 4.0, "stup*": 3.0}
    counts = sum(toxicity.triples(x) for x in prose(3, 80)).reshape(toxicity.CLASSES, toxicity.CLASSES, toxicity.CLASSES)
    own = toxicity.Restorer(counts, lexicon)

    def value(text, channel):
        a, b, p = 0, 0, channel
        for c in [*map(toxicity.class_of, text), 0]:
            p += own.model[a if b else 0, b, c]
            a, b = b, c
        return p

    r = random.Random(2)
    tokens = ["m*r*n", "m**on", "1d1*t", "@$$", "455", "81607", "l.o.s.e.r", "mor on", "i d i o t", "trraassh", "", "...", "stu*", "lo ser", "$tupid"]
    tokens += ["".join(r.choice("mroonidt10*@.$ |s") for _ in range(r.randint(1, 7))) for _ in range(300)]
    for t in tokens:
        paths = {x: value(x, p) for x, p in all_paths(t).items()}
        got, best = own.decode(t), max(paths.values())
        assert abs(paths[got] - best) < 1e-9, t
        spells = any(own.entry(x) for x in paths)
        assert spells == own.trie.ends(own.trie.walk({0}, toxicity.options(t))), t
        assert own.restored(t) == (own.entry(got) if spells else None)


def test_triples_in_chunks(monkeypatch):
    text = " ".join(prose(8, 40)).upper() + " é.x" * 9
    want = toxicity.triples(text.lower()).reshape(toxicity.CLASSES, -1)
    monkeypatch.setattr(toxicity, "CHUNK", 30)
    got = sum(toxicity.triples(x.lower()) for _, x in toxicity.chunks(text)).reshape(toxicity.CLASSES, -1)
    assert len(list(toxicity.chunks(text))) > 20 and (got[1:] == want[1:]).all()


def test_triples_of_all_documents(spark):
    texts = awkward()
    want = sum(toxicity.triples((t or "").lower()).astype(np.int64) for _, t in texts)
    got = toxicity.corpus_triples(frame(spark, texts))
    inner = got.reshape(toxicity.CLASSES, -1)[1:]  # after a letter: how texts are joined doesn't matter
    assert (inner == want.reshape(toxicity.CLASSES, -1)[1:]).all()
