"""Toxicity by noisy-channel deobfuscation: restore disguised words, then score the restored text.

What characters may stand for is a lattice: digits and signs for letters, a sign between letters or a repeated
letter for nothing, a space between tokens for nothing. The Viterbi path through it under a character model is the
restored text. The model counts character triples of all documents; the lexicon's words have a fixed part in it. The
lexicon holds the words, and beginnings of words, of labelled toxic rows that occur there, in different surroundings,
more often than chance allows. A small regression on how many of them the restored text has makes the score. The
labelled sample is bounded by `most` rows and `most_bytes` (quality.sample).

Only paths that spell an entry of the lexicon matter. A walk of all paths at once through the lexicon's trie tells
whether there is one; where there is none, no path need be decoded. The search keeps every state. A run of one sign
counts as three of it at most. A token of digits alone is a number, unless five or more of them spell a whole word.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import keyed, slabs, strings
from vecloom.llm.quality import sample

MOST, MOST_BYTES = 6000, 32 << 20
#: Character classes: 0 no letter, a-z, U+00DF to U+00FF, any other letter.
CLASSES = 1 + 26 + 33 + 1
LEXICON_SHARE, KEPT, RUN, CHUNK = 0.3, 200_000, 3, 1 << 20
EDGE = ".,;:!?%#&|\"'()[]{}<>~=+*$@-_/\\"
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c",
}
BETWEEN = ".-_*,'~/\\|+:;=#%&^`"
PREFIXES, EACH = (4, 5), 3
#: What can be at an end of a token without standing for a letter.
NEUTRAL = "".join(c for c in EDGE if c not in LEET and c != "*")
#: The channel's log probabilities that a space is one, and that it is within a word.
STAYS, JOINS = -0.05, -1.5
SPACE = re.compile(r"\s")
REPEATED = re.compile(r"([^\W\d_])\1")

def class_of(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else ord(c) - 0xDF + 27 if 0xDF <= ord(c) <= 0xFF and c != "÷" else CLASSES - 1 if c.isalpha() else 0


LUT = np.array([class_of(chr(k)) for k in range(1 << 16)], np.int64)


def triples(text: str) -> np.ndarray:
    """How often each class follows two others; what is before a boundary doesn't count."""
    code = LUT[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0xFFFF)]
    code = np.concatenate([[0, 0], code, [0]])
    a, b, c = code[:-2], code[1:-1], code[2:]
    return np.bincount((a * (b > 0) * CLASSES + b) * CLASSES + c, minlength=CLASSES**3)


def corpus_triples(docs: DataFrame) -> np.ndarray:
    """triples() summed over all documents; partial sums meet in a shuffle, one row for each first class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for b in batches:
            data, at = strings(b.column(0))
            for i, j in slabs(at, 1 << 20):
                parts = [data[x:y].tobytes().decode() for x, y in zip(at[i:j].tolist(), at[i + 1 : j + 1].tolist(), strict=True)]
                for _, some in chunks(" ".join(parts)):  # cut before white space, which is a boundary anyway
                    total += triples(some.lower())
        rows = total.reshape(CLASSES, -1)
        yield pa.RecordBatch.from_pydict({"a": pa.array(range(CLASSES), pa.int32()), "counts": pa.array([zlib.compress(x.tobytes(), 1) for x in rows], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"a": table.column("a")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    shape = "a int, counts binary"
    rows = keyed(docs).select("text").mapInArrow(count, shape).groupBy("a").applyInArrow(add, shape).collect()  # CLASSES rows
    out = np.zeros((CLASSES, CLASSES * CLASSES), np.int64)
    for a, counts in rows:
        out[a] = np.frombuffer(counts, np.int64)
    return out.reshape(CLASSES, CLASSES, CLASSES)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a class after two others, smoothed by those after one."""
    one = counts.sum(axis=0) + 0.5
    one = one / one.sum(axis=1, keepdims=True)
    return np.log((counts + 20 * one[None]) / (counts.sum(axis=2, keepdims=True) + 20))


class Trie:
    """The lexicon's words and beginnings (`abcd*`), letter by letter."""

    ANY = -1  # after a beginning: whatever follows

    def __init__(self, lexicon: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.whole, self.begins = set(), set()
        for e in lexicon:
            n = 0
            for c in e.rstrip("*"):
                if c not in self.next[n]:
                    self.next[n][c] = len(self.next)
                    self.next.append({})
                n = self.next[n][c]
            (self.begins if e[-1] == "*" else self.whole).add(n)

    def walk(self, nodes: set[int], options: Iterator[list[tuple[str, float]]], begins: bool = True) -> set[int]:
        """Where all paths of a lattice lead from these nodes."""
        for some in options:
            new = set()
            for x, _ in some:
                if not x:
                    new |= nodes
                    continue
                for n in nodes:
                    if begins and (n == self.ANY or n in self.begins):
                        new.add(self.ANY)
                    if n != self.ANY and x in self.next[n]:
                        new.add(self.next[n][x])
            nodes = new
            if not nodes:
                break
        return nodes

    def ends(self, nodes: set[int]) -> bool:
        return self.ANY in nodes or not self.whole.isdisjoint(nodes)


def options(token: str) -> Iterator[list[tuple[str, float]]]:
    """For each character what it may stand for, and the channel's log probability of that."""
    before, run = "", 0
    for c in token:
        run = run + 1 if c == before else 1
        if c.isalpha():
            yield [(c, -0.05 if run == 1 else -0.7)] + ([("", -0.7)] if run > 1 else [])
        elif c == " ":
            yield [(" ", STAYS), ("", JOINS)]
        elif run <= RUN:
            some = [(x, -3.0) for x in "abcdefghijklmnopqrstuvwxyz"] if c == "*" else [(x, -0.5) for x in LEET.get(c, "")]
            if c in BETWEEN or not some:
                some.append(("", -1.0))
            elif run > 1:
                some.append(("", -0.9))
            yield some
        before = c


NOWHERE: frozenset[int] = frozenset()


class Restorer:
    """Tokens as they were meant."""

    def __init__(self, counts: np.ndarray, lexicon: dict[str, float]):
        own = triples(" ".join(e for e in lexicon if e[-1] != "*")).reshape(counts.shape) if lexicon else np.zeros_like(counts)
        model = np.exp(log_model(counts))
        if lexicon:
            model = (1 - LEXICON_SHARE) * model + LEXICON_SHARE * np.exp(log_model(own * 20))
        self.model, self.lexicon, self.trie = np.log(model), lexicon, Trie(lexicon)
        self.longest = max([len(e) for e in lexicon], default=0)
        self.heads = {e[:3] for e in lexicon}  # no entry is shorter
        self.pieces = {e[:n]: frozenset(self.trie.walk({0}, options(e[:n]), False)) for e in lexicon if e[-1] != "*" for n in range(1, len(e) + 1) if not REPEATED.search(e[:n])}
        self.known: dict[str, tuple[str | None, frozenset[int]]] = {}

    def decode(self, token: str) -> str:
        """The Viterbi path through all states, which are the last two classes. Ties: the state that came first."""
        m = self.model
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for some in options(token):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (p, path) in states.items():
                for x, channel in some:
                    if x:
                        c = class_of(x)
                        key, q, t = (b, c), p + channel + m[a if b else 0, b, c], (path, x)
                    else:
                        key, q, t = (a, b), p + channel, path
                    if key not in new or new[key][0] < q:
                        new[key] = (q, t)
            states = new
        (_, path), out = max(((p + m[a if b else 0, b, 0], path) for (a, b), (p, path) in states.items()), key=lambda x: x[0]), []
        while path:
            path, x = path
            out.append(x)
        return "".join(reversed(out))

    def entry(self, word: str) -> str | None:
        return next((e for e in entries(word) if e in self.lexicon), None)

    def restored(self, text: str, begins: bool = True) -> str | None:
        """The entry that a text's best path spells, if any path spells one."""
        if not self.trie.ends(self.trie.walk({0}, options(text), begins)):
            return None
        found = self.entry(self.decode(text))
        return found if begins or (found and found[-1] != "*") else None

    def look(self, token: str) -> tuple[str | None, frozenset[int]]:
        """The entry that a lower-case token restores to, and where its paths lead in the trie if it begins a word that goes on."""
        core = token.strip(EDGE)
        found = self.entry(core) if core.isalpha() else None
        if found is None:
            forms = dict.fromkeys((core, token.strip(NEUTRAL), token.strip(NEUTRAL + "!"), token.rstrip(EDGE).lstrip(NEUTRAL), token.lstrip(EDGE).rstrip(NEUTRAL)))
            for text in forms:
                if not text or text.isalpha() and not REPEATED.search(text):
                    continue  # one path, which is no entry
                letters = any(map(str.isalpha, text))
                if not letters and text.isdigit() and len(text) < 5:
                    continue
                if found := self.restored(text, letters):
                    break
        return found, frozenset() if found or core.isdigit() else frozenset(self.trie.walk({0}, options(token.lstrip(NEUTRAL)), False) - {0})

    def known_(self, token: str) -> tuple[str | None, frozenset[int]]:
        """look(), without walks for tokens whose letters can only be themselves; what needs one is remembered."""
        core = token.strip(NEUTRAL)
        if core.isalpha() and not REPEATED.search(core):
            found = self.entry(core) if core[:3] in self.heads else None
            return (found, NOWHERE) if found else (None, self.pieces.get(core, NOWHERE))
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= KEPT:
                self.known.clear()
            found = self.known[token] = self.look(token)
        return found

    def spaced(self, tokens: list[str], i: int, nodes: frozenset[int]) -> tuple[str | None, int]:
        """The word that tokens from i are pieces of, and the token after it. nodes: where token i leads."""
        for j in range(i + 1, min(len(tokens), i + self.longest)):
            if not nodes:
                break
            for end in dict.fromkeys((tokens[j].rstrip(NEUTRAL), tokens[j].rstrip(EDGE))):
                if end and not self.trie.whole.isdisjoint(self.trie.walk(set(nodes), options(end), False)):
                    if found := self.restored(" ".join([*tokens[i:j], end]).lstrip(NEUTRAL), False):
                        return found, j + 1
            nodes = frozenset(self.trie.walk(set(nodes), options(tokens[j]), False))
        return None, i + 1

    def hits(self, text: str) -> tuple[int, list[str]]:
        """How many tokens a text has, and the lexicon's entries in it once restored. A long text goes in chunks."""
        n, out, left = 0, [], []
        for last, some in chunks(text):
            tokens = left + some.lower().split()
            n += len(tokens) - len(left)
            found = {t: x for t in set(tokens) if (x := self.known_(t)) != (None, NOWHERE)}
            stop = len(tokens) if last else max(0, len(tokens) - self.longest)
            at = stop  # the first token that no word found before holds
            if found:
                i = 0
                for k in [k for k, t in enumerate(tokens) if t in found]:
                    if i <= k < stop and (nodes := found[tokens[k]][1]):
                        entry, i = self.spaced(tokens, k, nodes)
                        if entry:
                            out.append(entry)
                            at = max(at, i)
                out += [e for t in tokens[:at] if t in found and (e := found[t][0])]
            left = tokens[at:]
        return n, out


def chunks(text: str) -> Iterator[tuple[bool, str]]:
    """Whether it is the last, and a part of the text that ends before white space."""
    i = 0
    while len(text) - i > 2 * CHUNK:
        found = SPACE.search(text, i + CHUNK)
        if not found:
            break
        yield False, text[i : found.start()]
        i = found.start()
    yield True, text[i:]


def entries(word: str) -> list[str]:
    """The lexicon entries that a word may match: itself, and its first four and five letters."""
    return [word] + [word[:n] + "*" for n in PREFIXES if len(word) > n]


def surroundings(text: str) -> Iterator[tuple[str, int]]:
    """Each word of letters and a hash of the words beside it."""
    tokens = [t.strip(EDGE) for t in text.lower().split()]
    for a, w, b in zip(["", *tokens], tokens, [*tokens[1:], ""]):
        if len(w) > 2 and w.isalpha():
            yield w, zlib.crc32(f"{a} {b}".encode())


def firsts(text: str) -> dict[str, list[int]]:
    """Each entry that a text matches, and what is beside its first EACH matches."""
    out: dict[str, list[int]] = {}
    for w, beside in surroundings(text):
        for e in entries(w):
            seen = out.setdefault(e, [])
            if len(seen) < EACH and beside not in seen:
                seen.append(beside)
    return out


def learn_lexicon(texts: list[str], y: np.ndarray) -> dict[str, float]:
    """Words, and beginnings of words, that toxic rows have beyond chance, and their log odds.

    A row counts EACH times for an entry at most, and places between the same neighbours count once; so neither
    long texts nor copies count for much.
    """
    toxic: dict[str, set[int]] = defaultdict(set)
    rows: dict[str, int] = defaultdict(int)
    for text, v in zip(texts, y.tolist(), strict=True):
        if v == 1:
            for e, beside in firsts(text).items():
                toxic[e].update(beside)
                rows[e] += 1
    some = {e: (len(x), set()) for e, x in toxic.items() if len(x) > EACH and rows[e] > EACH}
    least = math.log(len(toxic) + 1) + 4
    toxic.clear()
    for text, v in zip(texts, y.tolist(), strict=True):
        if v == 0:
            for e, beside in firsts(text).items():
                if e in some:
                    some[e][1].update(beside)
    q = (y.sum() + 1) / (len(y) + 2)
    out = {}
    for e, (t, clean) in some.items():
        n = len(clean)
        share = t / (t + n)
        gain = t * math.log(share / q) + (n * math.log((1 - share) / (1 - q)) if n else 0)
        if share > max(q, 0.5) and gain > least:
            out[e] = math.log((t + 0.5) / (n + 0.5) * (1 - q) / q)
    return out


def inputs(n: int, hits: list[str], lexicon: dict[str, float]) -> list[float]:
    """Of a text of n tokens: the greatest odds of an entry in it, those of the best five, how many hits, its length."""
    odds = sorted((lexicon[e] for e in set(hits)), reverse=True)[:5]
    return [1.0, odds[0] if odds else 0.0, sum(odds), math.log1p(len(hits)), math.log1p(n) / 10]


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression with a small penalty, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.05 * w)
    return w


class Model:
    def __init__(self, restorer: Restorer, w: np.ndarray):
        self.restorer, self.w = restorer, w

    def score(self, text: str) -> float:
        z = float(np.dot(inputs(*self.restorer.hits(text), self.restorer.lexicon), self.w))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, most: int = MOST, most_bytes: int = MOST_BYTES) -> Model:
    """The lexicon and regression from a bounded sample of the usable labelled rows, the character model from all documents."""
    data, y, prior = sample(docs, labels, "toxic", F.lit(True) if usable is None else usable, most, most_bytes)
    texts = [x.decode() for x in data]
    restorer = Restorer(corpus_triples(docs), learn_lexicon(texts, y))
    if not len(y):
        return Model(restorer, np.zeros(5))
    ones = max(1, int(y.sum()))
    weight = np.where(y == 1, prior / ones, (1 - prior) / max(1, len(y) - ones)) * len(y)
    x = np.array([inputs(*restorer.hits(t), restorer.lexicon) for t in texts])
    restorer.known.clear()
    return Model(restorer, regression(x, y, weight))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, key and score of each row, from its whole text. Null is empty; an empty text has no words and so a low score."""
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # two megabytes: CLASSES cubed, and the lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(packed.value)
        for b in batches:
            p = [own.score(x.as_py() or "") for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64())], ["doc_id", "key", "score"])

    return keyed(docs).select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, "doc_id long, key long, score double")
