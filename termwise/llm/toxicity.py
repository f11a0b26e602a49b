"""Toxic spans by a linear-chain conditional random field, and a score from them.

Labels mark whole documents, so tokens are labelled first: a form (a word, or
its first 4 to 8 letters) that toxic training documents hold far more often than
clean ones, by a likelihood-ratio test of each form that three toxic ones hold,
over all labelled training documents, labels its tokens in toxic documents. The field has two states and weights for
forms, for a neighbour that has such a form, and for the four transitions; it is
trained by gradient steps over every token of every labelled document. For that,
texts are cut into pieces: tokens with known forms and ``AROUND`` others on each
side, and the runs between, none longer than ``PIECE``. Equal pieces are counted,
so the gradient is a sum over the distinct ones, made by tasks; only the links
between pieces are left out. Toxic and clean documents weigh the same in all.
Forward and backward sums then give each token's marginal in any text; a logistic
curve over their sum, greatest and share, fitted on about ``FITTED`` training
documents, is the document's score. Runs of tokens at 0.5 or more are the offending spans.

Tokens are runs of letters, lower-cased; spans are code-point offsets of the
text. Null or empty texts, or texts without a letter, have no spans and the
score of a document without a toxic token. With no toxic or no clean training
document, all scores are 0. Labels that are null, or whose document is missing,
teach nothing; a document labelled twice counts for each label.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termwise.llm.texts import Memo, with_arrays, written

FORMS, FITTED, STEPS = 100_000, 20_000, 60
MARKS = 1 << 25
AROUND, PIECE, SHRINK = 4, 64, 0.1
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
_WORDS, _HELD = 200_000, 200_000
_WORD = regex.compile(r"\p{L}+")
_GROUP = 1 << 22


def forms(word: str) -> list[str]:
    word = word.lower()
    return [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and clean documents that hold each form; partial sums."""
    toxic, clean = Counter(), Counter()
    of = Memo(forms, _WORDS)

    def rows() -> Iterator[pa.RecordBatch]:
        found = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.string()), pa.array([toxic.get(f, 0) for f in found], pa.int64()),
             pa.array([clean.get(f, 0) for f in found], pa.int64())], ["form", "n", "other"])
        toxic.clear()
        clean.clear()

    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            if label in (0, 1):
                words = set(_WORD.findall(text or ""))
                (toxic if label else clean).update(set().union(*map(of.__getitem__, words)))
            if len(toxic) + len(clean) > 500_000:
                yield from rows()
    yield from rows()


def likelihood_ratio(a: Column, b: Column, of_a: int, of_b: int) -> Column:
    """Twice the log likelihood ratio of rates a/of_a and b/of_b; 0 where a's is not the greater."""
    both = (a + b) / F.lit(float(of_a + of_b))

    def term(k, n, p):
        def part(x, y):
            return F.when(x > 0, x * F.log(y)).otherwise(F.lit(0.0))

        return part(k, p) + part(F.lit(n) - k, F.lit(1.0) - p)

    rates = [(a, of_a, a / F.lit(float(of_a))), (b, of_b, b / F.lit(float(of_b)))]
    ratio = sum((term(k, n, p) - term(k, n, both) for k, n, p in rates), F.lit(0.0))
    return F.when(a * F.lit(of_b) <= b * F.lit(of_a), 0.0).otherwise(2 * ratio)


def chain(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, backward, marginal) of chains laid end to end.

    ``emission`` is the log odds of state 1 at each place, ``moves`` the four
    transition weights by (from, to). Forward and backward are log odds too; all
    chains step together, the longest first.
    """
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    top = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, top + 1), side="right")
    forward, backward = emission.copy(), np.zeros_like(emission)
    t00, t01, t10, t11 = moves
    for t in range(1, top):
        here = starts[:active[t]] + t
        x = forward[here - 1]
        forward[here] += np.logaddexp(t01, x + t11) - np.logaddexp(t00, x + t10)
    for t in range(top - 1, 0, -1):
        here = starts[:active[t]] + t
        x = emission[here] + backward[here]
        backward[here - 1] = np.logaddexp(t10, x + t11) - np.logaddexp(t00, x + t01)
    return forward, backward, 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))


def neighbours(has: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the token before, and the one after, has a known form."""
    has = has.astype(float)
    before, after = np.zeros_like(has), np.zeros_like(has)
    before[1:], after[:-1] = has[:-1], has[1:]
    ends = np.cumsum(lengths)[lengths > 0]
    before[ends - lengths[lengths > 0]] = 0
    after[ends - 1] = 0
    return before, after


def gradient(theta: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, forms: np.ndarray, toxic: np.ndarray,
             weight: np.ndarray) -> np.ndarray:
    """The gradient of the log likelihood of pieces laid end to end, and the weight of the tokens in state 1.

    ``lengths``: tokens of each piece; ``sizes``: known forms of each token;
    ``forms``: their numbers; ``toxic`` and ``weight``: of each piece.
    """
    n = len(theta) - 7
    bias, to_before, to_after = theta[-7:-4]
    moves = theta[-4:]
    has, w = sizes > 0, np.repeat(weight, lengths)
    before, after = neighbours(has, lengths)
    truth = (has & (np.repeat(toxic, lengths) > 0)).astype(float)
    sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), theta[forms], len(sizes))
    e = bias + sums + to_before * before + to_after * after
    forward, backward, p = chain(e, lengths, moves)
    miss = w * (truth - p)
    out = np.zeros(len(theta) + 1)
    out[:n] = np.bincount(forms, np.repeat(miss, sizes), n)[:n]
    out[n:n + 3] = miss.sum(), (miss * before).sum(), (miss * after).sum()
    first = np.zeros(len(sizes), bool)
    first[np.cumsum(lengths) - lengths] = True
    later = np.nonzero(~first)[0]
    seen = np.bincount((2 * truth[later - 1] + truth[later]).astype(np.int64), w[later], 4)
    a, x = forward[later - 1], e[later] + backward[later]
    odds = np.stack([np.full(len(later), moves[0]), moves[1] + x, moves[2] + a, moves[3] + a + x])
    odds = np.exp(odds - odds.max(axis=0))
    out[n + 3:n + 7] = seen - (w[later] * odds / odds.sum(axis=0)).sum(axis=1)
    out[-1] = (w * truth).sum()
    return out


def _gradients(shared):
    """The sum of ``gradient`` over a task's pieces, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta, weights = shared.value
        total = np.zeros(len(theta) + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, forms = batch.column("sizes"), batch.column("forms")
            toxic = batch.column("toxic").to_numpy()
            weight = np.where(toxic > 0, weights[1], weights[0]) * batch.column("n").to_numpy()
            total += gradient(theta, sizes.value_lengths().to_numpy().astype(np.int64),
                              sizes.flatten().to_numpy().astype(np.int64),
                              forms.flatten().to_numpy(zero_copy_only=False).astype(np.int64), toxic, weight)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["value"])

    return run


def cut(kinds: np.ndarray) -> Iterator[np.ndarray]:
    """A text's tokens in pieces: those with a kind and ``AROUND`` others on each side, and the runs between."""
    n, hits = len(kinds), np.nonzero(kinds)[0]
    edges = np.array([0, n])
    if len(hits):
        wide = np.nonzero(np.diff(hits) > 2 * AROUND + 1)[0]
        inner = np.concatenate([hits[:1] - AROUND, hits[wide + 1] - AROUND, hits[wide] + AROUND + 1,
                                hits[-1:] + AROUND + 1])
        edges = np.unique(np.concatenate([edges, np.clip(inner, 0, n)]))
    for lo, hi in zip(edges.tolist(), edges[1:].tolist()):
        for at in range(lo, hi, PIECE):
            yield kinds[at:min(at + PIECE, hi)]


def _pieces(shared):
    """How often each piece occurs, by label; partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = shared.value, Counter()

        def rows() -> pa.RecordBatch:
            keys = list(model.kinds) if counts else []
            pieces = [[keys[k] for k in np.frombuffer(x, np.int64).tolist()] for _, x in counts]
            return pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in counts], pa.int32()),
                 pa.array([[len(k) for k in x] for x in pieces], pa.list_(pa.int32())),
                 pa.array([[f for k in x for f in k] for x in pieces], pa.list_(pa.int32())),
                 pa.array(list(counts.values()), pa.int64())], ["toxic", "sizes", "forms", "n"])

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                counts.update((toxic, x.tobytes()) for x in cut(model.tokens([text])[0]))
                if len(counts) > _HELD:
                    yield rows()
                    counts.clear()
        yield rows()

    return run


class ToxicModel:
    """The field and the curve over its marginals."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon
        self.weights = np.zeros(len(lexicon))
        self.bias, self.before, self.after = 0.0, 0.0, 0.0
        self.moves = np.zeros(4)
        self.curve: np.ndarray | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("kinds", "kind", "sums")}

    def _kind(self, word: str) -> int:
        """The number of a word's set of known forms; 0 is none."""
        key = tuple(i for f in forms(word) if (i := self.lexicon.get(f)) is not None)
        return self.kinds.setdefault(key, len(self.kinds))

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(kind of each token, tokens of each text)."""
        if not hasattr(self, "kind"):
            self.kinds, self.sums = {(): 0}, np.zeros(1)
            self.kind = Memo(self._kind, _WORDS)
        got = [list(map(self.kind.__getitem__, _WORD.findall(x))) if x else [] for x in texts]
        lengths = np.array([len(x) for x in got], np.int64)
        return np.fromiter((k for x in got for k in x), np.int64, int(lengths.sum())), lengths

    def emission(self, kinds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if len(self.sums) < len(self.kinds):
            self.sums = np.array([sum(self.weights[i] for i in key) for key in self.kinds], float)
        before, after = neighbours(kinds > 0, lengths)
        return self.bias + self.sums[kinds] + self.before * before + self.after * after

    def train(self, pieces: DataFrame, weights: dict[int, float]) -> None:
        """Gradient steps on the log likelihood of all labelled tokens, with a little shrinkage.

        ``pieces``: (toxic, sizes, forms, n); ``weights``: of a document, by its label.
        """
        context = pieces.sparkSession.sparkContext
        theta = np.zeros(len(self.weights) + 7)
        theta[-7] = -3.0
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            shared = context.broadcast((theta, weights))
            parts = pieces.mapInArrow(_gradients(shared), "value binary").collect()
            shared.unpersist()
            total = sum((np.frombuffer(r["value"]) for r in parts), np.zeros(len(theta) + 1))
            # Shrinkage is per token, not per share of them: a rare form keeps its weight among many tokens.
            grad = (total[:-1] - SHRINK * theta) / max(1.0, total[-1])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            theta = theta + 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12)
        self._take(theta)

    def _take(self, theta: np.ndarray) -> None:
        self.weights, self.moves = theta[:-7], theta[-4:]
        self.bias, self.before, self.after = theta[-7:-4]
        self.sums = np.zeros(0)

    def _tagged(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        kinds, lengths = self.tokens(texts)
        return chain(self.emission(kinds, lengths), lengths, self.moves)[2], lengths

    def facts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum, greatest and share of the marginals by text; marginals; tokens by text)."""
        p, lengths = self._tagged(texts)
        out = np.zeros((len(texts), 3))
        filled = np.nonzero(lengths)[0]
        if len(filled):
            starts = (np.cumsum(lengths) - lengths)[filled]
            out[filled, 0] = np.log1p(np.add.reduceat(p, starts))
            out[filled, 1] = np.maximum.reduceat(p, starts)
            out[filled, 2] = np.add.reduceat(p, starts) / lengths[filled]
        return out, p, lengths

    def fit_curve(self, facts: np.ndarray, toxic: np.ndarray) -> None:
        """Logistic regression by Newton steps, with a little shrinkage."""
        x = np.column_stack([np.ones(len(facts)), facts])
        w, shrink = np.zeros(4), np.diag([1e-6, 0.05, 0.05, 0.05])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            bend = x.T @ (x * (p * (1 - p))[:, None]) + shrink
            w = w + np.linalg.solve(bend, x.T @ (toxic - p) - shrink @ w)
        self.curve = w

    def score(self, texts: list[str | None]) -> tuple[list[float], list[list[dict]]]:
        """Scores and spans (start, end, marginal) of texts, a few MB at a time."""
        scores, spans = [], []
        for group in grouped(texts):
            facts, p, lengths = self.facts(group)
            if self.curve is None:
                scores += [0.0] * len(group)
            else:
                lift = np.clip(self.curve[0] + facts @ self.curve[1:], -30, 30)
                scores += (1 / (1 + np.exp(-lift))).tolist()
            starts = np.cumsum(lengths) - lengths
            for i, text in enumerate(group):
                own = p[starts[i]:starts[i] + lengths[i]]
                spans.append(_spans(text, own) if self.curve is not None and (own >= 0.5).any() else [])
        return scores, spans


def grouped(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in their order, a few MB at a time."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < _GROUP):
            size += len(texts[end] or "")
            end += 1
        yield texts[at:end]
        at = end


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of tokens at 0.5 or more, with their greatest marginal."""
    out, open_ = [], False
    for found, q in zip(_WORD.finditer(text), p.tolist()):
        if q < 0.5:
            open_ = False
        elif open_:
            out[-1]["end"], out[-1]["marginal"] = found.end(), max(out[-1]["marginal"], q)
        else:
            out.append({"start": found.start(), "end": found.end(), "marginal": q})
            open_ = True
    return out


def _sample(rows: DataFrame, n: int, limit: int) -> DataFrame:
    """All of ``n`` rows, or about ``limit`` of them, the same ones each time: those with a low hash. Nothing moves."""
    if n <= limit:
        return rows
    return rows.filter(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) < F.lit((limit << 62) // n))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the documents with a label.

    Texts without one are left out before the shuffle: a bitmap of ``MARKS`` bits, of a fixed
    size whatever the number of labels, tells nearly all of them; the join tells the rest.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)) + 1
    bits = labels.select(place.alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("_part")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("_bits"))
    # Bit i of a bitmap is bit i % 8 of its byte i / 8.
    byte = F.conv(F.hex(F.expr("substring(_bits, bitmap_bit_position(_at) div 8 + 1, 1)")), 16, 10).cast("int")
    marked = (docs.select("doc_id", "text", place.alias("_at")).withColumn("_part", F.expr("bitmap_bucket_number(_at)"))
              .join(F.broadcast(bits), "_part")
              .filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(_at) % 8 as int))")) != 0))
    return marked.select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id")


def fit(train: DataFrame) -> ToxicModel:
    """Learns from (doc_id, text, toxic 0/1).

    Counts of forms and the training of the field cover every row. To the driver come
    the chosen forms, the strongest ``FORMS`` at most, sums by them, and the bounded sample named above.
    """
    spark = train.sparkSession
    rows = written(train.filter("toxic IS NOT NULL AND text IS NOT NULL")
                   .select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")), "labelled")
    of = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = of.get(1, 0), of.get(0, 0)
    model = ToxicModel({})
    if not n_toxic or not n_clean:
        return model
    counts = written(rows.select("text", "toxic").mapInArrow(_count, "form string, n long, other long")
                     .groupBy("form").agg(F.sum("n").alias("n"), F.sum("other").alias("other"))
                     .filter("n >= 3"), "forms")
    # Strong enough to stand out among as many forms as are looked at.
    least = 2 * math.log(counts.count() + 1) + 8
    ratio = likelihood_ratio(F.col("n"), F.col("other"), n_toxic, n_clean)
    chosen = (counts.filter(F.col("n") * n_clean > 10 * F.col("other") * n_toxic)
              .select("form", ratio.alias("ratio")).filter(F.col("ratio") >= least)
              .orderBy(F.col("ratio").desc(), "form").limit(FORMS))
    chosen = [r["form"] for r in chosen.collect()]
    model = ToxicModel({f: i for i, f in enumerate(sorted(chosen))})
    lexicon = spark.sparkContext.broadcast(model)
    pieces = written(rows.filter("toxic IN (0, 1)").select("text", "toxic")
                     .mapInArrow(_pieces(lexicon), "toxic int, sizes array<int>, forms array<int>, n long")
                     .groupBy("toxic", "sizes", "forms").agg(F.sum("n").alias("n")), "pieces")
    fewer = min(n_toxic, n_clean)
    model.train(pieces, {1: fewer / n_toxic, 0: fewer / n_clean})
    shared = spark.sparkContext.broadcast(model)

    def compute(texts: pa.Array) -> list[pa.Array]:
        found = [x for group in grouped(texts.to_pylist()) for x in shared.value.facts(group)[0].tolist()]
        return [pa.array(found, pa.list_(pa.float64()))]

    # Scoring a bounded sample spread over all labelled rows.
    fitted = with_arrays(_sample(rows, sum(of.values()), FITTED), "facts array<double>", compute, ["toxic"]).collect()
    model.fit_curve(np.array([r["facts"] for r in fitted]), np.array([r["toxic"] for r in fitted], float))
    return model


def score(docs: DataFrame, model: ToxicModel, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score, predicted and spans, from ``text`` alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def compute(texts: pa.Array) -> list[pa.Array]:
        scores, spans = shared.value.score(texts.to_pylist())
        return [pa.array(scores, pa.float64()), pa.array([int(x >= THRESHOLD) for x in scores], pa.int32()),
                pa.array(spans, span)]

    fields = "score double, predicted int, spans array<struct<start: int, end: int, marginal: double>>"
    return with_arrays(docs, fields, compute, keep)
