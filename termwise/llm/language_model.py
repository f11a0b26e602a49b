"""Log-likelihood of documents under a gated recurrent language model.

Tokens are lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` and one end per text.
Words are counted over every training text. The ``HEAD`` most frequent words are
symbols of the network; every other word is written as one of ``TAILS`` tail
classes, which its spelling gives. The output softmax is factored by class: head
words lie in classes of ``WIDTH`` by frequency, with a softmax over the class and
one within it; within a tail class, words have their corpus frequency with one
count added, and all words not seen in training share one more.

The network is trained by truncated backpropagation: documents run in lanes, a
window of ``STEPS`` tokens at a time, the state going on into the next window.
Each of ``ROUNDS`` rounds takes its own share of the documents, so that all are
seen once: every task trains a copy on its part of the share, and the copies are
averaged by the tokens they saw. So training, like counting, covers the corpus. Scoring carries the state from
window to window through whole documents.

Only bounded tables go to the tasks: the network and the ``LISTED`` most
frequent words with their counts. Counts of rarer words come by a join.

Null or empty texts: the end alone. Null ids are carried through; a repeated row
is counted and scored each time. Without training texts every score is that of
the untrained network, and base_score is 0.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termwise.llm.texts import Memo, parts, written

HEAD, WIDTH, TAILS, LISTED = 4096, 64, 96, 200_000
UNITS, INPUTS = 24, 16
ROUNDS, STEPS, LANES, RATE = 4, 16, 64, 0.12
_SCORE_LANES, _SCORE_STEPS = 256, 32
_TOKENS, _WORDS, _PIECE = 2_000_000, 100_000, 1 << 14
_MARKS = frozenset(b".,;:!?*$%&#|)]}\"'")
LN10 = math.log(10)


def tail_of(word: bytes) -> int:
    """The tail class of a word: by its first letters, and by whether it ends in a mark."""
    return crc32(word[:3]) % (TAILS // 2) * 2 + (word[-1] in _MARKS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Gated recurrent units between input symbols and a class-factored softmax.

    Symbols: 0 is the end, then head words, then tail classes; one more marks
    the start. Classes: head symbols by ``WIDTH``, then one per tail class.
    """

    NAMES = ("inputs", "gates", "bias", "moves", "classes", "class_bias", "words", "word_bias")

    def __init__(self, head: int, kind=np.float32, seed: int = 7):
        self.head = head
        self.groups = -(-head // WIDTH)
        self.start = head + TAILS
        rnd = np.random.default_rng(seed)
        full = self.groups * WIDTH
        shapes = {"inputs": (head + TAILS + 1, INPUTS), "gates": (INPUTS, 3 * UNITS), "bias": (3 * UNITS,),
                  "moves": (UNITS, 3 * UNITS), "classes": (self.groups + TAILS, UNITS),
                  "class_bias": (self.groups + TAILS,), "words": (full, UNITS), "word_bias": (full,)}
        spread = {"inputs": 0.3, "gates": INPUTS**-0.5, "moves": UNITS**-0.5}
        self.p = {k: (rnd.normal(0, spread[k], v) if k in spread else np.zeros(v)).astype(kind)
                  for k, v in shapes.items()}

    def start_from(self, symbol_counts: np.ndarray) -> None:
        """Biases that give each symbol its corpus frequency before any training."""
        full = np.zeros(self.groups * WIDTH)
        full[:self.head] = symbol_counts[:self.head] + 0.5
        in_class = np.concatenate([full.reshape(-1, WIDTH).sum(1), symbol_counts[self.head:] + 0.5])
        self.p["class_bias"][:] = np.log(in_class / in_class.sum())
        self.p["word_bias"][:] = np.where(full > 0, np.log(np.maximum(full, 1e-9)), -30.0)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def take(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            size = self.p[k].size
            self.p[k] = flat[at:at + size].reshape(self.p[k].shape).astype(self.p[k].dtype)
            at += size

    def states(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray):
        """Run a window. ``x`` (steps, lanes, 3 units) are the inputs' parts of the gates.

        Returns the states after each step and what going back needs.
        """
        moves, n = self.p["moves"], UNITS
        steps, lanes = keep.shape
        out = np.empty((steps, lanes, n), x.dtype)
        memory = []
        for t in range(steps):
            h = h * keep[t][:, None]
            a = h @ moves
            rz = _sigmoid(x[t, :, :2 * n] + a[:, :2 * n])
            new = np.tanh(x[t, :, 2 * n:] + rz[:, :n] * a[:, 2 * n:])
            memory.append((h, a[:, 2 * n:], rz, new))
            h = new + rz[:, n:] * (h - new)
            out[t] = h
        return out, memory

    def log_probs(self, h: np.ndarray, target: np.ndarray, grad: dict | None = None) -> np.ndarray:
        """Log probability of each target symbol from states (places, units).

        With ``grad``, adds the output's gradients to it and leaves the states' in ``grad["h"]``.
        """
        p = self.p
        tail = target >= self.head
        cls = np.where(tail, self.groups + target - self.head, target // WIDTH)
        rows = np.arange(len(h))
        logits = h @ p["classes"].T + p["class_bias"]
        logits -= logits.max(1, keepdims=True)
        odds = np.exp(logits)
        total = odds.sum(1)
        out = logits[rows, cls] - np.log(total)
        if grad is not None:
            odds /= total[:, None]
            odds[rows, cls] -= 1
            grad["classes"] += odds.T @ h
            grad["class_bias"] += odds.sum(0)
            grad["h"] = odds @ p["classes"]
        order = np.argsort(cls, kind="stable")
        ends = np.searchsorted(cls[order], np.arange(self.groups + 1))
        words, bias = p["words"].reshape(self.groups, WIDTH, -1), p["word_bias"].reshape(self.groups, WIDTH)
        sizes = np.diff(ends)
        level = np.frexp(sizes.astype(float))[1]
        # Classes of like size go together, filled up to the largest of them.
        for x in np.unique(level[sizes > 0]):
            own_g = np.nonzero(level == x)[0]
            most = np.arange(sizes[own_g].max())
            real = most < sizes[own_g][:, None]
            own = order[np.minimum(ends[own_g][:, None] + most, len(order) - 1)]
            own_h, own_words = h[own], words[own_g]
            place = np.where(real, target[own] - own_g[:, None] * WIDTH, 0)[..., None]
            logits = own_h @ own_words.transpose(0, 2, 1) + bias[own_g][:, None]
            logits -= logits.max(2, keepdims=True)
            odds = np.exp(logits)
            total = odds.sum(2, keepdims=True)
            out[own[real]] += (np.take_along_axis(logits, place, 2) - np.log(total))[real][:, 0]
            if grad is not None:
                odds /= total
                np.put_along_axis(odds, place, np.take_along_axis(odds, place, 2) - 1, 2)
                odds *= real[..., None]
                grad["words"].reshape(words.shape)[own_g] += odds.transpose(0, 2, 1) @ own_h
                grad["word_bias"].reshape(bias.shape)[own_g] += odds.sum(1)
                grad["h"][own[real]] += (odds @ own_words)[real]
        return out

    def loss_and_gradients(self, symbols, target, keep, live, h):
        """(loss, gradients, state) of a window (steps, lanes); ``live`` masks filling."""
        p, n = self.p, UNITS
        steps, lanes = symbols.shape
        emb = p["inputs"][symbols.ravel()]
        x = (emb @ p["gates"] + p["bias"]).reshape(steps, lanes, 3 * n)
        states, memory = self.states(x, keep, h)
        grad = {k: np.zeros_like(v) for k, v in p.items() if k != "inputs"}
        at = np.nonzero(live.ravel())[0]
        flat = states.reshape(-1, n)
        loss = -float(self.log_probs(flat[at], target.ravel()[at], grad).sum())
        d_out = np.zeros_like(flat)
        d_out[at] = grad.pop("h")
        d_out = d_out.reshape(steps, lanes, n)
        d_x = np.empty_like(x)
        back = np.zeros((lanes, n), x.dtype)
        for t in range(steps - 1, -1, -1):
            h0, a_new, rz, new = memory[t]
            r, z = rz[:, :n], rz[:, n:]
            dh = d_out[t] + back
            d_new = dh * (1 - z) * (1 - new * new)
            d_rz = np.concatenate([d_new * a_new, dh * (h0 - new)], 1) * rz * (1 - rz)
            d_x[t, :, :2 * n], d_x[t, :, 2 * n:] = d_rz, d_new
            d_a = np.concatenate([d_rz, d_new * r], 1)
            grad["moves"] += h0.T @ d_a
            back = (dh * z + d_a @ p["moves"].T) * keep[t][:, None]
        d_x = d_x.reshape(-1, 3 * n)
        grad["gates"] += emb.T @ d_x
        grad["bias"] += d_x.sum(0)
        which, place = np.unique(symbols.ravel(), return_inverse=True)
        d_in = np.zeros((len(which), INPUTS), x.dtype)
        np.add.at(d_in, place, d_x @ p["gates"].T)
        grad["inputs"] = (which, d_in)
        return loss, grad, states[-1]

    def train(self, docs: list[np.ndarray], rate: float = RATE) -> int:
        """Truncated backpropagation over documents in lanes; returns the tokens seen."""
        symbols, target, keep, live, _ = _streams(docs, LANES, self.start)
        kind = self.p["gates"].dtype
        seen = {k: np.full_like(v, 0.05) for k, v in self.p.items()}
        h = np.zeros((symbols.shape[1], UNITS), kind)
        for t in range(0, len(symbols), STEPS):
            w = slice(t, t + STEPS)
            count = int(live[w].sum())
            if not count:
                continue
            _, grad, h = self.loss_and_gradients(symbols[w], target[w], keep[w].astype(kind), live[w], h)
            # A sum over the window, held in bounds; Adagrad fits each weight's own step.
            size = math.sqrt(sum(float((g[1] if k == "inputs" else g).ravel() @ (g[1] if k == "inputs" else g).ravel())
                                 for k, g in grad.items())) / count
            scale = min(1.0, 1.0 / max(size, 1e-9)) * 10 / count
            for k, g in grad.items():
                rows, g = g if k == "inputs" else (slice(None), g)
                g = g * scale
                seen[k][rows] += g * g
                self.p[k][rows] -= rate * g / np.sqrt(seen[k][rows])
        return int(live.sum())

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        """Log probability of each document's symbols, states going on from window to window."""
        symbols, target, keep, live, places = _streams(docs, _SCORE_LANES, self.start)
        table = self.p["inputs"] @ self.p["gates"] + self.p["bias"]
        h = np.zeros((symbols.shape[1], UNITS), table.dtype)
        out = np.zeros(symbols.shape)
        for t in range(0, len(symbols), _SCORE_STEPS):
            w = slice(t, t + _SCORE_STEPS)
            states, _ = self.states(table[symbols[w]], keep[w].astype(table.dtype), h)
            h = states[-1]
            out[w][live[w]] = self.log_probs(states[live[w]], target[w][live[w]])
        sums = np.concatenate([np.zeros((1, out.shape[1])), np.cumsum(out, axis=0)])
        return np.array([sums[lo + n, lane] - sums[lo, lane] for lane, lo, n in places])


def _streams(docs: list[np.ndarray], most: int, start: int):
    """Documents end to end in lanes: (symbols, target, keep, live) by step and lane, and places.

    The next document goes to the lane that is free first, the longest first;
    few lanes are used where one document is long, so little is filled up.
    """
    total, longest = sum(map(len, docs)), max(map(len, docs), default=1)
    lanes = max(1, min(most, len(docs), total // longest))
    free = [(0, i) for i in range(lanes)]
    places: list[tuple[int, int, int]] = [(0, 0, 0)] * len(docs)
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        at, lane = heapq.heappop(free)
        places[d] = (lane, at, len(docs[d]))
        heapq.heappush(free, (at + len(docs[d]), lane))
    steps = max(at for at, _ in free)
    target = np.zeros((steps, lanes), np.int32)
    symbols = np.full((steps, lanes), start, np.int32)
    keep, live = np.ones((steps, lanes), bool), np.zeros((steps, lanes), bool)
    for (lane, at, n), doc in zip(places, docs):
        target[at:at + n, lane] = doc
        symbols[at + 1:at + n, lane] = doc[:-1]
        keep[at, lane] = False
        live[at:at + n, lane] = True
    return symbols, target, keep, live, places


class Words:
    """Codes of words: the end, the listed words, then a code per tail class for all others."""

    def __init__(self, listed: list[tuple[bytes, int]], n_docs: int, n_tokens: int, kinds: int,
                 tails: dict[int, tuple[int, int]]):
        """``tails``: words and kinds of words by tail class, head words left out."""
        self.words = [w for w, _ in listed]
        self.head = 1 + min(HEAD - 1, len(listed))
        counts = np.array([n_docs, *(c for _, c in listed)], float)
        self.n_tokens, self.kinds = n_tokens, kinds
        sums = np.array([tails.get(k, (0, 0)) for k in range(TAILS)], float).reshape(TAILS, 2)
        self.symbol_counts = np.concatenate([counts[:self.head], sums[:, 0]])
        rest = [tail_of(w) for w in self.words[self.head - 1:]]
        self.symbol = np.array([*range(self.head), *(self.head + k for k in rest),
                                *range(self.head, self.head + TAILS)], np.int32)
        # What a word adds to the base score, and to the model's beyond its symbol; others get theirs by the join.
        self.log_count = np.concatenate([np.log10(counts + 1), np.zeros(TAILS)])
        self.log_total = math.log10(n_tokens + kinds + 1)
        in_tail = self.symbol >= self.head
        self.beyond = np.where(in_tail, self.log_count, 0.0)
        self.beyond[in_tail] -= np.log10(sums.sum(1) + 1)[self.symbol[in_tail] - self.head]
        self.known = np.concatenate([counts > 0, np.zeros(TAILS, bool)])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("code", "other")}

    def codes(self, text: bytes) -> tuple[np.ndarray, Counter]:
        """The codes of a text's tokens, and how often each word occurs that is not listed."""
        if not hasattr(self, "code"):
            self.code = {w: i + 1 for i, w in enumerate(self.words)}
            self.other = Memo(lambda w: 1 + len(self.words) + tail_of(w), _WORDS)
        code, other, rest, runs = self.code.get, self.other, Counter(), []
        for part in parts(text.lower()):
            words = part.split()
            got = np.fromiter((code(w, -1) for w in words), np.int64, len(words))
            for i in np.nonzero(got < 0)[0].tolist():
                got[i] = other[words[i]]
                rest[words[i]] += 1
            runs.append(got)
        return np.concatenate([*runs, [0]]), rest


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())],
            ["token", "c"])

    for batch in batches:
        for text in batch.column("text").cast(pa.large_binary()):
            for part in parts((text.as_py() or b"").lower()):
                counts.update(part.split())
            if len(counts) > 400_000:
                yield rows()
                counts.clear()
    yield rows()


def _tail_sums(head: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((TAILS, 2), np.int64)
        for batch in batches:
            for word, c in zip(batch.column("token").cast(pa.large_binary()).to_pylist(), batch.column("c").to_pylist()):
                if word not in head:
                    sums[tail_of(word)] += (c, 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(TAILS), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])],
                                         ["k", "words", "kinds"])

    return run


def _train(shared):
    """One copy of the network trained on a task's documents, in pieces with its weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, network, rate = shared.value
        mine, seen = Network(network.head), 0
        mine.take(network.flat())
        for docs in _coded(batches, words):
            seen += mine.train([words.symbol[codes] for _, codes, _ in docs], rate)
        if seen:
            flat = mine.flat()
            pieces = [flat[i:i + _PIECE].astype("<f4").tobytes() for i in range(0, len(flat), _PIECE)]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(pieces)), pa.int32()), pa.array([task % 16] * len(pieces), pa.int32()),
                 pa.array([float(seen)] * len(pieces)), pa.array(pieces, pa.binary())],
                ["piece", "part", "weight", "value"])

    return run


_PIECES = "piece int, part int, weight double, value binary"


def _mean(key: tuple, rows: pa.Table) -> pa.Table:
    """The weighted mean of copies of one piece."""
    weights = rows.column("weight").to_numpy()
    total = sum(w * np.frombuffer(v.as_buffer(), "<f4").astype(float) for w, v in zip(weights, rows.column("value")))
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()),
                     "weight": pa.array([weights.sum()]),
                     "value": pa.array([(total / weights.sum()).astype("<f4").tobytes()], pa.binary())})


def _coded(batches: Iterator[pa.RecordBatch], words: Words):
    """Lists of (row, codes, rest), of some millions of tokens each; a row is its batch and place."""
    held, size = [], 0
    for batch in batches:
        for i, text in enumerate(batch.column("text").cast(pa.large_binary())):
            codes, rest = words.codes(text.as_py() or b"")
            held.append(((batch, i), codes.astype(np.int32), rest))
            size += len(codes)
            if size >= _TOKENS:
                yield held
                held, size = [], 0
    if held:
        yield held


class Model:
    def __init__(self, words: Words, network: Network, counts: DataFrame):
        self.words, self.network, self.counts = words, network, counts


def fit(train: DataFrame) -> Model:
    """Counts every text of ``train`` (doc_id, text) and trains the network on each once, a share a round."""
    spark = train.sparkSession
    train = train.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = written(train.select("text").mapInArrow(_count, "token string, c long")
                     .groupBy("token").agg(F.sum("c").alias("c")), "counts")
    n_words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_docs = train.count()
    listed = [(r["token"].encode(), r["c"])
              for r in counts.orderBy(F.col("c").desc(), "token").limit(LISTED).collect()]
    head = frozenset(w for w, _ in listed[:HEAD - 1])
    tails = (counts.mapInArrow(_tail_sums(head), "k int, words long, kinds long")
             .groupBy("k").agg(F.sum("words").alias("words"), F.sum("kinds").alias("kinds")).collect())
    words = Words(listed, n_docs, n_words + n_docs, kinds + (n_docs > 0), {r["k"]: (r["words"], r["kinds"]) for r in tails})
    network = Network(words.head)
    network.start_from(words.symbol_counts)
    draw = F.pmod(F.xxhash64(F.lit("lm"), "doc_id", "text"), F.lit(ROUNDS))
    for step in range(ROUNDS):
        shared = spark.sparkContext.broadcast((words, network, RATE / (1 + step)))
        means = (train.filter(draw == step).select("text").mapInArrow(_train(shared), _PIECES)
                 .groupBy("piece", "part").applyInArrow(_mean, _PIECES)
                 .groupBy("piece").applyInArrow(_mean, _PIECES).collect())
        if means:
            flat = b"".join(bytes(r["value"]) for r in sorted(means, key=lambda r: r["piece"]))
            network = Network(words.head)
            network.take(np.frombuffer(flat, "<f4"))
        shared.unpersist()
    return Model(words, network, counts)


_SCORED = ("_key long, n_tokens long, _known long, _base double, _score double, "
           "_rest array<struct<token: string, n: int>>")


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score, from ``text`` alone.

    ``keep`` names the columns of ``docs`` to return, by default all. Columns of
    ``docs`` that bear an added name are replaced.
    """
    out = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = docs.drop(*out)
    kept = [x for x in docs.columns if keep is None or x in keep]
    own = [x for x in docs.columns if x in kept or x == "text"]
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.network))
    schema = StructType([docs.schema[x] for x in kept] + StructType.fromDDL(_SCORED).fields)
    rest_kind = pa.list_(pa.struct([("token", pa.string()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, network = shared.value
        key = TaskContext.get().partitionId() << 40
        for rows in _coded(batches, words):
            logs = network.scores([words.symbol[codes] for _, codes, _ in rows]) / LN10
            for at in range(0, len(rows), 512):
                part = rows[at:at + 512]
                kept_rows = [x.slice(i, 1).select(kept) for (x, i), _, _ in part]
                columns = pa.Table.from_batches(kept_rows).combine_chunks() if kept else None
                yield pa.RecordBatch.from_arrays([
                    *([columns.column(x).combine_chunks() for x in kept] if kept else []),
                    pa.array(range(key, key + len(part)), pa.int64()),
                    pa.array([len(c) for _, c, _ in part], pa.int64()),
                    pa.array([int(words.known[c].sum()) for _, c, _ in part], pa.int64()),
                    pa.array([float(words.log_count[c].sum()) - len(c) * words.log_total for _, c, _ in part]),
                    pa.array([float(x + words.beyond[c].sum()) for x, (_, c, _) in zip(logs[at:at + 512], part)]),
                    pa.array([[{"token": w.decode(), "n": n} for w, n in r.items()] for _, _, r in part], rest_kind),
                ], schema.names)
                key += len(part)

    scored = written(docs.select(*own).mapInArrow(run, schema), "scored")
    gain: Column = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)
    rest = (scored.select("_key", F.inline("_rest")).join(model.counts, "token", "left")
            .groupBy("_key").agg(F.sum(gain).alias("_more"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("_some")))
    more = F.coalesce("_more", F.lit(0.0))
    return scored.join(rest, "_key", "left").select(
        *kept, "n_tokens", (F.col("_known") + F.coalesce("_some", F.lit(0))).alias("n_known"),
        F.lit(model.words.n_tokens).cast("long").alias("train_tokens"), (F.col("_base") + more).alias("base_score"),
        (F.col("_score") + more).alias("score"))
