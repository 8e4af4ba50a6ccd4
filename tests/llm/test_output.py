import hashlib
import io
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from llm.helpers import awkward, frame, prose
from pyspark.sql import functions as F

from vecloom.llm import audio, decontaminate, edit_counts, mixing, token_files
from vecloom.llm.common import NULL_ID

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def ids_of(own, texts):
    ids, n = own.ids(pa.array(texts, pa.string()))
    end = np.cumsum(n).tolist()
    return [ids[a:b].tolist() for a, b in zip([0, *end], end)]


def plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_tokens_round_trip(spark):
    texts = [*awkward(), (700, "İstanbul Σίσυφος ς, é it's DON'T a%%%. x,y"), (701, "<|endoftext|> and <|ENDOFTEXT|>"), (702, "1,2.\u0085 z\tq")]
    got = [tuple(r) for r in token_files.tokens_of(frame(spark, texts), TOKENIZER).collect()]
    rows = sorted(((NULL_ID if d is None else d, t or "") for d, t in texts), key=lambda r: r[0])
    ids = {k: np.array([*x, 1], "<u4") for k, x in zip(range(len(rows)), plain([t for _, t in rows]))}
    want = sorted((d, len(ids[k]), zlib.crc32(ids[k].tobytes())) for k, (d, _) in enumerate(rows))
    assert sorted((NULL_ID if d is None else d, n, c) for d, _, n, c in got) == want
    at = 0
    for d, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    order = [NULL_ID if r[0] is None else r[0] for r in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order)
    assert token_files.tokens_of(frame(spark, []), TOKENIZER).count() == 0


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_file_format(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 10)
    out, docs = io.BytesIO(), [(3, np.arange(25, dtype="<u4")), (9, np.array([1], "<u4")), (12, np.array([65535] * 10, "<u4"))]
    w = token_files.FrameWriter(out, 2)
    for d, ids in docs:
        w.document(d, ids)
    w.close()
    data = out.getvalue()
    r = token_files.FrameReader(Source(data))
    assert r.documents[:, 0].tolist() == [3, 9, 12] and r.documents[:, 2].tolist() == [3, 1, 1]
    assert all((r.ids(k) == ids).all() for k, (_, ids) in enumerate(docs))
    plain_ = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()  # any reader skips the seek table
    assert plain_[:50] == np.arange(25, dtype="<u2").tobytes()
    broken = bytearray(data)
    broken[int(r.begin[3]) + 8] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.FrameReader(Source(bytes(broken))).ids(1)
    with pytest.raises(ValueError):
        token_files.FrameReader(Source(data[:-1]))


def test_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "WORDS_KEPT", 50)
    own, texts = token_files.WordEncoder(TOKENIZER), prose(5, 30, 30)
    got = [x for t in texts for x in ids_of(own, [t])]
    assert got == plain(texts) and len(own.known) <= 200


def test_words_give_the_ids_of_whole_texts(monkeypatch):
    """Every letter, mark, number and sign of the Unicode tables, before and after what ends a word, and long texts in parts."""
    own, r = token_files.WordEncoder(TOKENIZER), random.Random(11)
    of = {}
    for c in map(chr, range(32, 0x30000)):
        of.setdefault(unicodedata.category(c), []).append(c)
    of = {k: v for k, v in of.items() if k[0] in "LMNPSZ"}
    marks = list(token_files.STOPS) + ["'s", "'T", "-", "(", ")", "<|", "</w>", "\u0307", "\u093c", "\n", "\t", "\u0085", "1"]
    texts = ["ALİ.", 'ESKİ! yeni', "DİLİ, güzel", "\u0958. \ufb1d, x", "ǅ. ſ! ß? K;", "<|ENDOFTEXT|> <|endoftext|>x y."]
    texts += [f"a{c}. {c}, {c}a! x{c}" for c in [c for k, v in of.items() if k[0] == "L" for c in (v if len(v) < 3000 else r.sample(v, 1000))]]
    for _ in range(6000):
        word = lambda: "".join(r.choice(of[r.choice(list(of))]) if r.random() < 0.4 else r.choice("abcXYZİé") for _ in range(r.randint(1, 5)))
        texts.append(" ".join(word() + "".join(r.choices(marks, k=r.randint(0, 3))) for _ in range(r.randint(1, 6))))
    texts += ["", "a", ".", "", "A.", "\n.", ".b", "c"]
    got = [x for i in range(0, len(texts), 97) for x in ids_of(own, texts[i : i + 97])]
    assert got == plain(texts)
    monkeypatch.setattr(token_files, "PART", 50)
    for t in (" ".join(texts[100:300]), "x" * 130, "x" * 70 + " y" * 70, " " * 200):
        assert "".join(token_files.parts(t)) == t
        assert ids_of(own, [t]) == plain([t])


def windows_of(words, m):
    return [tuple(words[i : i + m]) for i in range(len(words) - m + 1)]


def brute_contamination(texts, items, longest=False):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    known = {}
    for item, t in items:
        w = find(t)
        for x in windows_of(w, min(13, len(w))) if w else []:
            known.setdefault(x, set()).add("" if item is None else str(item))
    out = []
    for d, t in texts:
        w, hit, some = find(t), set(), set()
        for m in {len(x) for x in known}:
            for i, x in enumerate(windows_of(w, m)):
                if x in known:
                    hit |= set(range(i, i + m))
                    some |= known[x]
        out.append((d, len(w), len(hit), len(some), hashlib.sha256(",".join(sorted(some)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), max((len(x) for x in known if x in windows_of(w, len(x))), default=0)))
    out = out if longest else [r[:-1] for r in out]
    return sorted(out, key=repr)


@pytest.mark.parametrize("pattern_bytes", [1 << 20, 150])
def test_contamination(spark, pattern_bytes):
    texts = awkward()
    stock = [t for _, t in texts if t and len(t) > 150][:8]
    items = [(k, t[20:140]) for k, t in enumerate(stock)] + [(20, "Shared LINE!"), (21, "é"), (22, None), (23, "..."), (None, stock[0][40:90]), (100, stock[1][:60]), (101, " ".join(stock)), (102, stock[2][20:140])]
    texts += [(3000, stock[0].upper().replace(" ", " -- ")), (3001, " ".join(["word"] * 900) + " " + stock[1][20:140])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(frame(spark, texts), bench, pattern_bytes=pattern_bytes)
    got = sorted((tuple(r) for r in decontaminate.digest(found).collect()), key=repr)
    want = brute_contamination(texts, items)
    assert got == want and sum(w[5] for w in want) > 5 and any(w[2] and not w[5] for w in want)
    kept = decontaminate.drop_contaminated(frame(spark, texts), bench, pattern_bytes=pattern_bytes)
    assert kept.columns == frame(spark, texts).columns
    whole = brute_contamination(texts, items, longest=True)
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(w[0]) for w in whole if not w[5] and w[6] < decontaminate.SURE)
    assert any(w[6] >= 13 and not w[5] for w in whole)  # a passage in a long text goes too


def test_long_texts_are_searched_in_pieces(monkeypatch):
    monkeypatch.setattr(decontaminate, "SLAB", 64)
    r, stock = random.Random(3), ["ab", "b", "cde", "x" * 90, "é", "q7"]
    say = lambda n: " ".join(r.choice(stock) + r.choice(["", "--", " . ", "\n" * 70]) for _ in range(n))
    texts = [say(n) for n in (40, 200, 400)] + [" " * 700, "x" * 700, "", "ab " + "." * 400 + " b cde q7" * 9]
    items = [(str(k), t) for k, t in enumerate([texts[1][100:300], texts[2][50:90], "ab b cde", say(30), "é", texts[6]])]
    own = decontaminate.Searcher(items, 13)
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        n, n_hit, longest, bits, found = own.run(data, np.array([0, len(data)]))
        (_, words, hits, n_items, sha, _, most), = brute_contamination([(0, t)], items, longest=True)
        assert (n[0], n_hit[0], longest[0], len(found[0])) == (words, hits, most, n_items) and hashlib.sha256(",".join(found[0]).encode()).hexdigest() == sha
        assert int.from_bytes(bits[0], "big").bit_count() == hits


def test_items_come_in_bounded_pieces(spark):
    long = " ".join(prose(9, 200))
    blocks = list(decontaminate.pattern_blocks(spark.createDataFrame([(1, long), (2, "short"), (3, None)], "item_id long, text string"), 500, 13))
    assert all(sum(len(t or "") for _, t in b) <= 500 for b in blocks) and len(blocks) > 5
    words = long.split()
    assert {x for b in blocks for i, t in b if i == "1" for x in windows_of(t.split(), 13)} == set(windows_of(words, 13))


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    texts = awkward()
    assert decontaminate.contamination(frame(spark, texts), none).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(frame(spark, []), none).count() == 0


def water(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            break
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    return {s: 2.0 * sizes[s] if s in capped else level * w[s] for s in order}


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    monkeypatch.setattr(mixing, "FAN", 2)
    texts = awkward() + [(5000 + i, t) for i, t in enumerate(prose(8, 150))]
    docs = frame(spark, texts, sources=("b", "a", "b", None, "", "b", "ä", "Z"))
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts)
    sizes, want = {}, {}
    for r, s in ((r, r.source) for r in docs.collect()):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        want.setdefault(NULL_ID if r.doc_id is None else r.doc_id, []).append(n)
        sizes[s] = sizes.get(s, 0) + n
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.size)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    target = water(sizes)
    largest = max(r.size for r in rows)
    for s in sizes:
        mine = [r for r in rows if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) < largest
        ratio = target[s] / sizes[s] if sizes[s] else 0
        assert all(r.taken == r.copies * r.size and (not r.size or int(ratio) <= r.copies <= int(ratio) + 1) and r.taken <= 2 * r.size for r in mine)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    taken = mixing.mixed(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in rows)
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mixed(frame(spark, [])).count() == 0


def test_words_of_long_texts_are_counted_in_pieces(monkeypatch):
    for piece in (1, 2, 7, 1 << 20):
        monkeypatch.setattr(mixing, "PIECE", piece)
        for t in ("", " ", "a", " a b  c\n", "é\u3000é x" * 5, "\x0b\x1cabc d"):
            data = np.frombuffer(("zz" + t).encode(), np.uint8)
            assert mixing.count_words(data, np.array([2, len(data)])).tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t))]


def test_pivot_keeps_mass_and_expectations():
    r, n, sums = random.Random(2), 12, np.zeros(12)
    size = [float(r.randint(1, 9)) for _ in range(n)]
    start = [0.3] * n
    for _ in range(6000):
        p, left = mixing.pivot(size, start, [r.random() for _ in range(n)])
        assert abs(np.dot(p, size) - np.dot(start, size)) < 1e-9 and sum(0 < x < 1 for x in p) == (left >= 0)
        sums += p
    assert np.abs(sums / 6000 - 0.3).max() < 0.03


def test_audio(spark, tmp_path):
    texts = awkward()
    folder = (tmp_path / "tensors").as_uri()
    rows = audio.media_features(frame(spark, texts), folder).collect()
    assert len(rows) == len(texts)
    seen = {}
    want, payloads = {}, set()
    for d, t in texts:
        b = (t or "").encode()
        payload = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
        payloads.add(payload)
        want.setdefault(NULL_ID if d is None else d, set()).add((len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(payload) + 44, hashlib.sha256(audio.to_wav(payload)).hexdigest()))
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) in want[r.doc_id]
        assert seen.setdefault(r.payload_sha256, r.feature) == r.feature
        assert all(s.begin_s < s.end_s for s in r.spans) and (r.tensor_file is None) == (not r.spans)
        if r.spans:
            stored = audio.read_tensors(folder, r.tensor_file).slice(r.tensor_row, len(r.spans))
            assert stored.schema.field("tensor").type == audio.TENSOR and set(stored.column("doc_id").to_pylist()) == {r.doc_id} and set(stored.column("key").to_pylist()) == {r.key}
            assert stored.column("segment").to_pylist() == list(range(len(r.spans))) and stored.column("end_s").to_pylist() == [s.end_s for s in r.spans]
            payload = next(p for p in payloads if hashlib.sha256(p).hexdigest() == r.payload_sha256)
            mel, energy = audio.log_mel(payload)
            values = stored.column("tensor").combine_chunks().to_numpy_ndarray()
            assert values.shape == (len(r.spans), audio.FRAMES, audio.MELS) and np.allclose(values, audio.tensors(mel, audio.segments(energy)), atol=0.01)
    assert max(len(r.spans) for r in rows) > 1
    assert audio.media_features(frame(spark, [])).count() == 0


def test_tensor_files_end_where_they_were_written(tmp_path, monkeypatch):
    class Task:
        partitionId = taskAttemptId = lambda self: 3

    monkeypatch.setattr(audio.TaskContext, "get", staticmethod(Task))
    monkeypatch.setattr(audio, "FLUSH", 5)
    (tmp_path / "t").mkdir()
    for counts in ([5], [2, 0, 3, 5], [1, 5, 2], [12]):
        writer, values, at = audio.TensorWriter((tmp_path / "t").as_uri()), np.random.default_rng(1).normal(size=(20, audio.FRAMES, audio.MELS)), 0
        for d, n in enumerate(counts):
            name, row = writer.write(d, -d, [{"begin_s": float(k), "end_s": k + 1.0} for k in range(n)], values[at : at + n])
            assert (row == at and name) if n else name is None
            at += n
        writer.close()
        stored = audio.read_tensors((tmp_path / "t").as_uri(), writer.name)
        assert stored.column("doc_id").to_pylist() == [d for d, n in enumerate(counts) for _ in range(n)]
        assert np.allclose(stored.column("tensor").combine_chunks().to_numpy_ndarray(), values[:at], atol=0.01)
    audio.TensorWriter((tmp_path / "t").as_uri()).close()  # no segments: no file


def test_wav_and_resampling():
    import wave

    with wave.open(io.BytesIO(audio.to_wav(bytes(range(192))))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(192)) == (1, 1, audio.RATE, bytes(range(192)))
    for bad in (b"", b"RIFF0000WAVE", b"x" * 50):
        with pytest.raises(ValueError):
            audio.from_wav(bad)
    data = np.random.default_rng(1).integers(0, 256, 301).astype(np.uint8)
    x = (data.astype(float) - 128) / 128
    for rate, target in ((2, 1), (16_000, 8_000), (3, 2), (44_100, 16_000), (8_000, 16_000), (5, 7)):
        own = audio.Resampler(rate, target)
        n = own.size(len(data))
        assert n == math.ceil(len(data) * target / rate)
        direct = [sum(own.filter[k] * x[m] for m in range(len(x)) if 0 <= (k := i * own.down + own.shift - m * own.up) < len(own.filter)) for i in range(n)]
        assert np.allclose(own.run(data, 0, n), direct, atol=1e-4)
        assert np.allclose(own.run(data, 17, 90), direct[17:90], atol=1e-4)
    tone = lambda hz, rate, n: np.round(128 + 100 * np.sin(2 * np.pi * hz * np.arange(n) / rate)).astype(np.uint8)
    slow = audio.Resampler(16_000, 8_000)
    assert np.abs(slow.run(tone(500, 16_000, 4000), 100, 1900) - 100 / 128 * np.sin(2 * np.pi * 500 * np.arange(100, 1900) / 8_000 - 0)).max() < 0.35
    assert np.abs(slow.run(tone(7_000, 16_000, 4000), 100, 1900)).max() < 0.1  # above the new band
    energy = np.array([0, 0, 9, 9, 4.6, 9, 0, 0, 0, 4.6, 0], float)
    assert audio.segments(energy).tolist() == [[2, 6]]
    assert audio.segments(np.ones(5)).tolist() == []


def test_log_mel_against_a_plain_transform(monkeypatch):
    for n in (192, 400, 401, 1000, 5000):
        samples = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
        mel, energy = audio.log_mel(samples)
        x = audio.RESAMPLER.run(np.frombuffer(samples, np.uint8), 0, -(-n // 2)).astype(float)
        count = 1 + max(0, math.ceil((len(x) - audio.WINDOW) / audio.HOP))
        assert len(mel) == len(energy) == count and (count - 1) * audio.HOP + audio.WINDOW >= len(x)
        x = np.concatenate([x, np.zeros(audio.WINDOW + audio.HOP)])
        k, t = np.arange(audio.FFT // 2 + 1), np.arange(audio.WINDOW)
        basis = np.exp(-2j * np.pi * np.outer(t, k) / audio.FFT)
        for i in range(count):
            f = x[i * audio.HOP : i * audio.HOP + audio.WINDOW]
            f = (f - f.mean()) * np.hanning(audio.WINDOW)
            assert np.allclose(mel[i], np.log(np.abs(f @ basis) ** 2 @ audio.BANK + 1e-6), atol=1e-3)
            assert abs(energy[i] - 10 * np.log10((f * f).mean() + 1e-10)) < 1e-3
        monkeypatch.setattr(audio, "GROUP", 3)
        parts = audio.log_mel(samples)
        monkeypatch.setattr(audio, "GROUP", 1024)
        assert np.allclose(parts[0], mel, atol=1e-4) and np.allclose(parts[1], energy, atol=1e-4)


def test_edits_against_encoding_again(spark):
    own = edit_counts.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    r = random.Random(7)
    parts = ["a", "b", " ", "  ", "\n", "'", "s", "'s", "é", "1", ".", "!", " \n ", "word", "\t", "’", "end.", "12"]
    text = lambda n: "".join(r.choice(parts) for _ in range(n))
    for _ in range(400):
        tree = edit_counts.Tree.of(own, text(r.choice([0, 1, 5, 30, 700])))
        for turn in range(4):
            if turn == 2:  # stored and loaded
                tree = edit_counts.Tree.load(own, *tree.store())
            place, drop, put = r.randint(0, len(tree.text)), r.choice([0, 0, 1, 3, 60]), text(r.choice([0, 1, 3, 200]))
            want = tree.text[:place] + put + tree.text[place + drop :]
            tree.edit(place, drop, put)
            assert tree.text == want and tree.total == len(own.encoding.encode_ordinary(want))
            assert [s for size, _ in tree.leaves for s in size] == [len(x) for x in own.pattern.findall(want)]
            assert tree.chars[1] == len(want)


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def edited(text, edits):
    for place, drop, put in edits:
        place = min(max(place or 0, 0), len(text))
        text = text[:place] + (put or "") + text[place + (drop or 0) :]
    return text


def test_edited_counts(spark):
    texts = awkward()
    found = edit_counts.edited_counts(frame(spark, texts), RANKS, public_tokenizers.PATTERN)
    own = edit_counts.Counter(RANKS, public_tokenizers.PATTERN)
    count, want = lambda t: len(own.encoding.encode_ordinary(t)), []
    for d, t in texts:
        d, t = NULL_ID if d is None else d, t or ""
        n = len(t)
        new = edited(t, [(n // 4, 0, f" edit {d} here"), (n // 2, 8, ""), (3 * n // 4, 5, "Changed")])
        want.append((d, n, count(t), count(new)))
    assert sorted(map(tuple, found.select("doc_id", "n_chars", "n_tokens", "n_tokens_edited").collect())) == sorted(want)
    long = found.orderBy(F.desc("n_pieces")).first()
    assert long.n_reencoded < long.n_pieces / 20
    assert edit_counts.edited_counts(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_a_table_of_edits(spark):
    texts, r = awkward(), random.Random(5)
    edits = [(r.choice([d for d, _ in texts]), r.randint(0, 3), r.randint(-2, 90), r.choice([0, 3, None]), r.choice(["", "new words, ", None, "é"])) for _ in range(150)] + [(987654, 0, 0, 0, "no such document")]
    table = spark.createDataFrame(edits, "doc_id long, seq int, place int, drop int, put string")
    trees = edit_counts.build_trees(frame(spark, texts), RANKS, public_tokenizers.PATTERN)
    once = edit_counts.apply_edits(edit_counts.with_edits(trees, table), RANKS, public_tokenizers.PATTERN, keep=True)
    again = edit_counts.apply_edits(edit_counts.with_edits(once.select(trees.columns), table), RANKS, public_tokenizers.PATTERN, keep=True)
    own = edit_counts.Counter(RANKS, public_tokenizers.PATTERN)
    low = lambda x: -(2**40) if x is None else x
    mine = lambda d: [e[2:] for e in sorted((e for e in edits if e[0] == d), key=lambda e: (e[1], e[2], low(e[3]), e[4] or ""))]
    for found, turns in ((once, 1), (again, 2)):
        want = []
        for d, t in texts:
            new = t or ""
            for _ in range(turns):
                new = edited(new, mine(d))
            want.append((NULL_ID if d is None else d, len(mine(d)), len(own.encoding.encode_ordinary(new)), new))
        assert sorted(map(tuple, found.select("doc_id", "n_edits", "n_tokens_edited", "text").collect())) == sorted(want)


def test_arrow_lists_of_tensors_are_empty_without_segments():
    none = audio.as_tensors(np.zeros((0, audio.FRAMES, audio.MELS)))
    assert len(none) == 0 and isinstance(none, pa.ExtensionArray) and none.type == audio.TENSOR
