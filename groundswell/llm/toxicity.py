"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as the vector of its hashed bucket (word input) beside the sum, by the root of their number, of its hashed
four-byte grams' vectors (character input). Two recurrent passes read the text, each word's state in the light of the
CONTEXT to CONTEXT + WINDOW - 1 words before it (or after it, for the pass that comes back): the text is read in
stretches of WINDOW words, each begun CONTEXT words early. Attention then pools the states of every window of WINDOW
words, one beginning at each word, and a logistic unit scores the window; the text's score is its likeliest window's.
As the unit is linear, a window's score is a ratio of sums of two numbers a word, so that all overlapping windows of a
whole text cost little more than its states.

Training knows only whether a document is toxic: it learns from the likeliest window of each toxic document, and from
the likeliest and some random windows of the others, chosen anew as the network improves; the first choice follows
the log-odds of buckets. Labelled documents are a sample of at most SAMPLE of each label, by a hash of the id. The
network has a fixed size and ships with the tasks.

Defined results: a null or empty text is one window without words, scored like any; a text of fewer words than a window
is one window. Labels other than 0 and 1, ids with both labels and documents without a label or an id are not learnt
from; of an id's texts the smallest counts. Repeated rows are scored alike; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import parts, table
from .quality_model import in_fold, labelled_texts

WINDOW, CONTEXT = 24, 8
LENGTH = WINDOW + 2 * CONTEXT
FORTH, BACK = range(LENGTH - CONTEXT), range(LENGTH - 1, CONTEXT - 1, -1)
POOLED = slice(CONTEXT, CONTEXT + WINDOW)
WORD_BUCKETS, WORD_SIZE = 8192, 8
GRAMS, CHAR_SIZE = 32768, 12
HIDDEN, ATTENTION = 12, 8
SAMPLE = 1200
REMEMBERED = 150_000
FADE = 0.01
MARKS = ".,;:!?\"'()[]#*$%&|<>-"

Net = dict[str, np.ndarray]


# --- inputs -----------------------------------------------------------------------------------------------------


def word_inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its bucket; and the four-byte grams of all words in one array, with where each word's begin."""
    lower = [w.lower() for w in words]
    bucket = np.array([zlib.crc32((w.strip(MARKS) or w).encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in lower], dtype=np.int64)
    raw = [b"\2" + w.encode("utf-8", "surrogatepass") + b"\3\3" for w in lower]
    size = np.array([len(r) - 3 for r in raw], dtype=np.int64)
    letters = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint32)
    begins = np.cumsum(size + 3) - (size + 3)
    firsts = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(begins - firsts, size)
    mixed = (letters[at] * np.uint32(0x9E3779B1)) ^ (letters[at + 1] * np.uint32(0x85EBCA77)) ^ (letters[at + 2] * np.uint32(0xC2B2AE3D)) ^ (letters[at + 3] * np.uint32(0x27D4EB2F))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return bucket, ((mixed >> np.uint32(8)) % np.uint32(GRAMS)).astype(np.int64), firsts


def stretch(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Word indexes from CONTEXT words before each start on, LENGTH of them; -1 outside a text of n words."""
    at = start[:, None] + np.arange(-CONTEXT, LENGTH - CONTEXT)
    return np.where((at >= 0) & (at < n[:, None]), at, -1)


# --- network ----------------------------------------------------------------------------------------------------


def fresh(seed: int = 11) -> Net:
    rng = np.random.default_rng(seed)
    size, n = WORD_SIZE + CHAR_SIZE, HIDDEN
    draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
    net = {"word": 0.1 * rng.normal(size=(WORD_BUCKETS, WORD_SIZE)).astype(np.float32), "char": 0.1 * rng.normal(size=(GRAMS, CHAR_SIZE)).astype(np.float32)}
    for way in "fb":
        net |= {f"w{way}": draw(size, 3 * n), f"u{way}": draw(n, 3 * n), f"c{way}": np.zeros(3 * n, np.float32)}
    return net | {"att": draw(2 * n, ATTENTION), "pick": draw(ATTENTION, 1)[:, 0], "out": draw(2 * n, 1)[:, 0], "bias": np.zeros(1, np.float32)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def vectors(net: Net, bucket: np.ndarray, grams: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    sizes = np.diff(np.append(firsts, len(grams)))[:, None]
    return np.hstack([net["word"][bucket], np.add.reduceat(net["char"][grams], firsts, axis=0) / np.sqrt(sizes, dtype=np.float32)])


def recurrent(pre: list[np.ndarray], live: np.ndarray, u: np.ndarray, order: range) -> tuple[np.ndarray, list]:
    """States after each word, and what the way back needs. pre: by word, the input's share of the three gates."""
    n = HIDDEN
    h, states, trace = np.zeros((len(live), n), np.float32), np.zeros((len(live), LENGTH, n), np.float32), []
    for t in order:
        x, hu, m = pre[t], h @ u, live[:, t, None]
        g = sigmoid(x[:, : 2 * n] + hu[:, : 2 * n])
        z, r = g[:, :n], g[:, n:]
        new = np.tanh(x[:, 2 * n :] + r * hu[:, 2 * n :])
        trace.append((t, h, z, r, new, hu[:, 2 * n :]))
        h = np.where(m, new + z * (h - new), h)
        states[:, t] = h
    return states, trace


def pooled(net: Net, states: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, ...]:
    a = np.tanh(states @ net["att"])
    e = np.where(live, a @ net["pick"], -1e9)
    e = np.exp(e - e.max(1, keepdims=True)) * live
    share = e / np.maximum(e.sum(1, keepdims=True), 1e-9)
    pool = (share[:, :, None] * states).sum(1)
    return pool @ net["out"] + net["bias"], a, share, pool


def word_scores(net: Net, gates: np.ndarray, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For all words of docs (rows of gates), end to end: attention before its exponent, and the logistic unit's share."""
    n, size = 3 * HIDDEN, np.array([len(d) for d in docs], dtype=np.int64)
    flat = np.append(np.concatenate(docs) if docs else [], -1).astype(np.int64)
    each = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(docs)), each)
    start = (np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)) * WINDOW
    first = (np.cumsum(size) - size)[doc]
    pull, share = np.zeros(len(flat) - 1), np.zeros(len(flat) - 1)
    for at in range(0, len(doc), 2048):
        some = slice(at, at + 2048)
        inside = stretch(start[some], size[doc[some]])
        live = inside >= 0
        rows = np.where(live, flat[first[some, None] + np.maximum(inside, 0)], -1).T
        states = []
        for k, (way, order) in enumerate((("f", FORTH), ("b", BACK))):
            pre = {t: gates[rows[t], k * n : (k + 1) * n] for t in order}
            states.append(recurrent(pre, live, net[f"u{way}"], order)[0][:, POOLED])
        h = np.concatenate(states, 2)
        own, place = live[:, POOLED], (first[some, None] + inside[:, POOLED])
        pull[place[own]] = (np.tanh(h @ net["att"]) @ net["pick"])[own]
        share[place[own]] = (h @ net["out"])[own]
    return pull, share


def sliding(x: np.ndarray, combine) -> np.ndarray:  # noqa: ANN001
    """combine over each WINDOW (24) values running, by runs of 1, 2, 4, 8 and 16."""
    run = x
    for k in (1, 2, 4):
        run = combine(run[:-k], run[k:])
    both = combine(run[:-8], run[8:])
    return combine(both[:-8], run[16:])


def window_starts(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid end to end, each at least a window long: where each begins, how many windows each has, and all windows' starts."""
    room = np.maximum(size, WINDOW)
    begin, windows = np.cumsum(room) - room, room - WINDOW + 1
    starts = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(begin, windows)
    return begin, windows, starts


def laid_out(values: np.ndarray, size: np.ndarray, begin: np.ndarray, blank: float) -> np.ndarray:
    """A number a word, at its place in the layout of window_starts."""
    out = np.full(int(np.maximum(size, WINDOW).sum()), blank)
    out[np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)] = values
    return out


def window_logits(net: Net, gates: np.ndarray, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of every window of every text, end to end; and where each text's begin."""
    size = np.array([len(d) for d in docs], dtype=np.int64)
    begin, windows, starts = window_starts(size)
    pull, share = word_scores(net, gates, docs)
    pull = laid_out(pull, size, begin, -np.inf)
    top = np.maximum.reduceat(pull, begin)
    e = np.exp(pull - np.repeat(np.where(np.isfinite(top), top, 0), np.maximum(size, WINDOW)))
    total = sliding(e, np.add)[starts]
    return sliding(e * laid_out(share, size, begin, 0.0), np.add)[starts] / np.maximum(total, 1e-30) + float(net["bias"][0]), np.cumsum(windows) - windows


def gates_of(net: Net, x: np.ndarray) -> np.ndarray:
    return np.hstack([x @ net[f"w{way}"] + net[f"c{way}"] for way in "fb"])


def gradients(net: Net, x: np.ndarray, live: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[Net, np.ndarray, float]:
    """Of the weighted logistic loss: by parameter, and by input vector x (windows with their context, words, size)."""
    n, g = HIDDEN, {}
    passes = {}
    for way, order in (("f", FORTH), ("b", BACK)):
        pre = x @ net[f"w{way}"] + net[f"c{way}"]
        passes[way] = recurrent([pre[:, t] for t in range(LENGTH)], live, net[f"u{way}"], order)
    states = np.concatenate([passes["f"][0], passes["b"][0]], 2)[:, POOLED]
    score, a, share, pool = pooled(net, states, live[:, POOLED])
    p = sigmoid(score)
    loss = float(-(weight * np.log(np.where(y == 1, p, 1 - p) + 1e-7)).sum())
    d = (weight * (p - y)).astype(np.float32)
    g["out"], g["bias"] = pool.T @ d, d.sum(keepdims=True)
    d_pool = d[:, None] * net["out"]
    d_states = share[:, :, None] * d_pool[:, None, :]
    d_share = (states * d_pool[:, None, :]).sum(2)
    d_e = share * (d_share - (share * d_share).sum(1, keepdims=True))
    g["pick"] = np.einsum("btk,bt->k", a, d_e)
    d_a = d_e[:, :, None] * net["pick"] * (1 - a * a)
    g["att"] = np.einsum("bti,btk->ik", states, d_a)
    d_states += d_a @ net["att"].T
    d_x = np.zeros_like(x)
    for k, way in enumerate("fb"):
        u, d_pre = net[f"u{way}"], np.zeros((len(x), LENGTH, 3 * n), np.float32)
        d_h, d_u = np.zeros((len(x), n), np.float32), np.zeros_like(u)
        for t, h, z, r, new, hu in reversed(passes[way][1]):
            if CONTEXT <= t < CONTEXT + WINDOW:
                d_h += d_states[:, t - CONTEXT, k * n : (k + 1) * n]
            m = live[:, t, None]
            d_out = d_h * m
            d_n = d_out * (1 - z) * (1 - new * new)
            d_z, d_r = d_out * (h - new) * z * (1 - z), d_n * hu * r * (1 - r)
            d_pre[:, t] = np.hstack([d_z, d_r, d_n])
            d_hu = np.hstack([d_z, d_r, d_n * r])
            d_u += h.T @ d_hu
            d_h = d_h * ~m + d_out * z + d_hu @ u.T
        g[f"u{way}"], g[f"c{way}"] = d_u, d_pre.sum((0, 1))
        g[f"w{way}"] = np.einsum("bti,btk->ik", x, d_pre)
        d_x += d_pre @ net[f"w{way}"].T
    return g, d_x, loss


# --- training ---------------------------------------------------------------------------------------------------


def log_odds(y: np.ndarray, owners: np.ndarray, features: np.ndarray, size: int) -> np.ndarray:
    """Of a document being toxic, by feature held, each document's features counted once; rare features stay near 0."""
    seen = np.unique(owners.astype(np.int64) * size + features)
    bad = np.bincount(seen % size, weights=y[seen // size], minlength=size)
    every = np.bincount(seen % size, minlength=size)
    share = y.mean()
    p, q = (bad + 3 * share) / y.sum(), (every - bad + 3 * (1 - share)) / (1 - y).sum()
    return np.log(p / q).astype(np.float32)


def train(examples: list[tuple[str, int]], rounds: int = 5, epochs: int = 1, batch: int = 128, rate: float = 0.005, seed: int = 3) -> Net:
    """A network from (text, label) pairs; without both labels or any word, one that gives every text one score by the share of label 1."""
    net, rng = fresh(), np.random.default_rng(seed)
    y = np.array([label for _, label in examples], dtype=np.float32)
    if not 0 < y.sum() < len(y) or not any(text.split() for text, _ in examples):
        net["out"][:] = 0
        net["bias"][:] = 4 * (y.mean() - 0.5) if len(y) else -2
        return net
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in text.split()], dtype=np.int64) for text, _ in examples]
    bucket, grams, firsts = word_inputs(list(index))
    sizes = np.diff(np.append(firsts, len(grams)))
    owners, held = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate(docs)
    # Log-odds ask for each document's different words and grams once; narrow numbers keep the driver small.
    pairs = np.unique(owners * np.int64(len(index)) + held)
    del owners, held
    owner, own_word = (pairs // len(index)).astype(np.int32), (pairs % len(index)).astype(np.int32)
    word_odds = log_odds(y, owner, bucket[own_word], WORD_BUCKETS)
    count = sizes[own_word].astype(np.int32)
    gram_at = np.arange(int(count.sum()), dtype=np.int32) - np.repeat((np.cumsum(count) - count - firsts[own_word]).astype(np.int32), count)
    gram_odds = log_odds(y, np.repeat(owner, count), grams[gram_at], GRAMS)
    del gram_at, owner, own_word
    net["word"][:, 0], net["char"][:, 0] = word_odds, gram_odds
    hint = word_odds[bucket] + np.maximum.reduceat(gram_odds[grams], firsts)
    sizes_of = np.array([len(d) for d in docs], dtype=np.int64)
    text, text_begin = np.append(np.concatenate(docs), -1), np.cumsum(sizes_of) - sizes_of
    begin, per_doc, places = window_starts(sizes_of)
    doc_of, starts = np.repeat(np.arange(len(docs)), per_doc), np.cumsum(per_doc) - per_doc
    start_of = places - begin[doc_of]
    clean = np.flatnonzero(y[doc_of] == 0)
    scores = sliding(laid_out(hint[text[:-1]], sizes_of, begin, -9.0), np.maximum)[places] + 1e-6 * rng.random(len(places))
    start = {k: np.zeros_like(net[k]) for k in ("word", "char")}
    start["word"][:, 0], start["char"][:, 0] = word_odds, gram_odds
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    steps = 0
    for turn in range(rounds):
        if turn:
            scores, _ = window_logits(net, np.vstack([gates_of(net, vectors(net, bucket, grams, firsts)), np.zeros((1, 6 * HIDDEN), np.float32)]), docs)
        top = np.flatnonzero(scores == np.repeat(np.maximum.reduceat(scores, starts), per_doc))
        best = top[np.unique(doc_of[top], return_index=True)[1]]  # the first of each text's likeliest
        some = rng.choice(clean, min(len(clean), 4 * int((y == 0).sum())), replace=False)
        chosen = np.unique(np.concatenate([best, some]))
        target = y[doc_of[chosen]]
        weight = np.where(target == 1, 0.25 / max(1, target.sum()), 0.75 / max(1, (1 - target).sum())).astype(np.float32) * len(chosen)
        for _ in range(epochs):
            order = rng.permutation(len(chosen))
            for at in range(0, len(order), batch):
                k = order[at : at + batch]
                own_doc = doc_of[chosen[k]]
                inside = stretch(start_of[chosen[k]], sizes_of[own_doc])
                live = inside >= 0
                ids = np.where(live, text[text_begin[own_doc][:, None] + np.maximum(inside, 0)], -1)
                used, inverse = np.unique(np.maximum(ids, 0), return_inverse=True)
                own = np.concatenate([grams[firsts[w] : firsts[w] + sizes[w]] for w in used])
                begin = np.cumsum(sizes[used]) - sizes[used]
                x = vectors(net, bucket[used], own, begin)[inverse.reshape(ids.shape)]
                told = np.ones(x.shape, np.float32)  # half of the words come without their word input, which is easy to learn by heart
                told[:, :, :WORD_SIZE] = rng.random(ids.shape)[:, :, None] < 0.5
                x *= told
                g, d_x, _ = gradients(net, x, live, target[k], weight[k] / len(k))
                d_word = np.zeros((len(used), d_x.shape[2]), np.float32)
                np.add.at(d_word, inverse.ravel(), (d_x * told * live[:, :, None]).reshape(-1, d_x.shape[2]))
                g["word"], g["char"] = np.zeros_like(net["word"]), np.zeros_like(net["char"])
                np.add.at(g["word"], bucket[used], d_word[:, :WORD_SIZE])
                np.add.at(g["char"], own, np.repeat(d_word[:, WORD_SIZE:] / np.sqrt(sizes[used])[:, None], sizes[used], axis=0))
                steps += 1
                for name, grad in g.items():
                    m, v = moments[name]
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    if name in ("word", "char"):  # what the loss does not hold up fades
                        net[name] -= FADE * (net[name] - start[name])
                    net[name] -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    return net


# --- scoring ----------------------------------------------------------------------------------------------------


class Scorer:
    """Scores texts; remembers words' gate inputs up to a bound."""

    def __init__(self, net: Net) -> None:
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.gates = np.zeros((1024, 6 * HIDDEN), np.float32)

    def learn(self, words: list[str]) -> None:
        need = len(self.index) + len(words) + 1
        if need > len(self.gates):
            self.gates = np.vstack([self.gates[:-1], np.zeros((max(need, 2 * len(self.gates)) - len(self.gates) + 1, 6 * HIDDEN), np.float32)])
        for at in range(0, len(words), 8192):
            some = words[at : at + 8192]
            self.gates[len(self.index) : len(self.index) + len(some)] = gates_of(self.net, vectors(self.net, *word_inputs(some)))
            self.index.update(zip(some, range(len(self.index), len(self.index) + len(some)), strict=True))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        words = [(t or "").split() for t in texts]
        if len(self.index) > REMEMBERED:
            self.clear()
        index = self.index
        if new := list({w for ws in words for w in ws if w not in index}):
            self.learn(new)
        scores, starts = window_logits(self.net, self.gates, [np.fromiter(map(index.__getitem__, ws), dtype=np.int64, count=len(ws)) for ws in words])
        return sigmoid(np.maximum.reduceat(scores, starts))


def scored(docs: DataFrame, net: Net) -> DataFrame:
    """docs (doc_id, text) as doc_id, score."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            out = [scorer.scores(texts) for texts in parts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str, sample: int = SAMPLE) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(labelled_texts(docs, table(spark, sf_dir, "labels"), "toxic", ~in_fold(F.col("id"), 3, 1), sample))
    return scored(docs, net).select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
