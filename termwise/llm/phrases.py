"""Collocations from a weighted de Bruijn graph of words, one graph a language.

Pieces are what ``[.,;:!?\\x0A-\\x0D]`` leaves of a text, words ``[^\\x20\\x09]+`` of
a piece, lower-cased in A-Z. Edges are phrases of ``LONGEST`` words, nodes those of
one word less; an edge leads from its first words to its last.

1. Cuts: each word and each pair of neighbours is counted by a 64-bit hash. Two
   neighbours counted less than ``least`` times are in no phrase counted that often,
   so a piece can end between them; hashes that meet, and the filter of ``FILTER``
   bits that carries the result to tasks, only leave cuts out, never a phrase.
2. Edges: pieces leave the tasks as the runs of words between cuts, so the rows follow
   the words, each handed on about once. Spark makes the edges of a run and counts
   equal ones: each word starts one phrase, of ``LONGEST`` words or up to the end of its
   piece; the short ones are the corrections at piece ends.
3. Flow: a phrase of k words occurs as often as those of k + 1 that start with it,
   plus once for each piece that ends with it. So every shorter count comes from the
   level above, and the texts are not read again.
4. Paths: where one edge brings all of a node's occurrences and one takes them all
   on, the two are joined, by doubling, into unary paths. The nodes inside a path lie
   in a longer phrase that is as frequent, so they are out before phrases are compared.
5. Scores: every cut of a phrase in two is scored, the lowest counts.

Null or empty texts, and texts of separators, have no words. A null language is
``und``. Repeated rows count as often as they stand there. Ties of the score go to the
more frequent phrase, then to the lesser in UTF-8. An empty table gives no rows. Only
``text`` and ``lang`` are read, so other columns of any name do not matter.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termwise.llm.texts import Memo, as_bytes, written

LEAST, LONGEST, MOST = 100, 5, 2000
FILTER = 1 << 26
_ROWS, _HASHES, _BYTES, _MEMO, _KEPT_WORD, _RUN = 256, 1 << 22, 1 << 25, 200_000, 64, 64
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


class _Hashes(Memo):
    """Hashes of words; those of long words are not kept."""

    def __missing__(self, word):
        return super().__missing__(word) if len(word) <= _KEPT_WORD else xxhash.xxh64_intdigest(word)


class _Words:
    """The words of some texts of one language: hashes of words and of neighbours, and where pieces end."""

    def __init__(self, lang: str, texts: list[bytes], hashes: Memo):
        self.words, sizes = [], []
        for text in texts:
            for piece in text.lower().translate(_ENDS).split(b"\n"):
                if found := piece.split():
                    self.words += found
                    sizes.append(len(found))
        n = len(self.words)
        plain = np.fromiter(map(hashes.__getitem__, self.words), np.uint64, n)
        seed = np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1))
        self.singles = _mixed(plain + seed)
        self.within = np.ones(max(n - 1, 0), bool)
        self.within[np.cumsum(sizes[:-1], dtype=np.int64) - 1] = False
        self.pairs = _mixed(self.singles[:-1] * _ODD[0] + plain[1:])


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    hashes = _Hashes(xxhash.xxh64_intdigest, _MEMO)
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            groups = defaultdict(list)
            for lang, text in zip(part.column("lang").to_pylist(), as_bytes(part.column("text"))):
                groups[lang].append(text)
            for lang, texts in groups.items():
                yield lang, _Words(lang, texts, hashes)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text IS NOT NULL")


def _count_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view("<i8")), pa.array(n.astype("<i8"))], ["h", "n"])

    for _, words in _by_lang(batches):
        held += [words.singles, words.pairs[words.within]]
        size += len(held[-1]) + len(held[-2])
        if size >= _HASHES:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def frequent(docs: DataFrame, least: int) -> np.ndarray:
    """A filter of ``FILTER`` bits: set, at two places, for every word and pair of neighbours counted ``least`` times."""
    counts = _texts(docs).mapInArrow(_count_hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    place = F.explode(F.array(*(F.expr(f"1 + (shiftrightunsigned(h, {by}) & {FILTER - 1}L)") for by in (0, 32))))
    parts = (counts.filter(F.col("n") >= least).select(place.alias("at"))
             .groupBy(F.expr("bitmap_bucket_number(at)").alias("part"))
             .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits")))
    whole = np.zeros(FILTER // 8, np.uint8)
    for part, bits in parts.collect():  # at most FILTER bits in all
        whole[(part - 1) * 4096:part * 4096] = np.frombuffer(bytes(bits), np.uint8)
    return whole


def _holds(whole: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found, mask = np.ones(len(hashes), bool), np.uint64(8 * len(whole) - 1)
    for by in (0, 32):
        at = (hashes >> np.uint64(by)) & mask
        found &= (whole[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found


def _runs(words: _Words, whole: np.ndarray, longest: int) -> tuple[np.ndarray, pa.RecordBatch]:
    """Where frequent words stand alone, and the runs of words between rare pairs, as (words, starts).

    A run is handed on in parts of ``_RUN`` words; each has what the phrases need that its words start.
    """
    n = len(words.words)
    joined = words.within & _holds(whole, words.pairs)
    first = np.nonzero(np.concatenate([[True], ~joined]))[0]
    size = np.diff(np.append(first, n))
    one = first[size == 1]
    alone = one[_holds(whole, words.singles[one])]
    first, size = first[size > 1], size[size > 1]
    cuts = -(-size // _RUN)
    at = np.repeat(first, cuts) + _RUN * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    left = np.repeat(first + size, cuts) - at
    wide = np.minimum(left, _RUN + longest - 1)
    ends = np.cumsum(wide)
    places = np.repeat(at - ends + wide, wide) + np.arange(wide.sum())
    found = _lists(list(map(words.words.__getitem__, places.tolist())), np.append(0, ends))
    return alone, pa.RecordBatch.from_arrays([found, pa.array(np.minimum(left, _RUN).astype("<i4"))], ["words", "starts"])


def _lists(words: list[bytes], offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype("<i4")), pa.array(words, pa.binary()).cast(pa.string()))


def runs(docs: DataFrame, whole, longest: int) -> DataFrame:
    """(lang, words, starts, n): runs of words that the filter ``whole`` leaves, the first ``starts`` of which start a phrase.

    Words that stand alone are counted in their task; one word without letters stands for the number of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = defaultdict(Counter), 0
        names = ["lang", "words", "starts", "n"]

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in found.items():
                ones = pa.array(np.ones(len(counts), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counts), pa.string()), _lists(list(counts), np.arange(len(counts) + 1)), ones,
                     pa.array(counts.values(), pa.int64())], names)

        for lang, words in _by_lang(batches):
            if not words.words:
                continue
            alone, parts = _runs(words, whole.value, longest)
            size = parts.num_rows
            if size:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size, pa.string()), *parts.columns, pa.array(np.ones(size, "<i8"))], names)
            counts = found[lang]
            counts[b""] += len(words.words)
            before = len(counts)
            counts.update(map(words.words.__getitem__, alone.tolist()))
            # A word costs its own bytes and about a hundred more.
            held += (len(counts) - before) * (100 + sum(map(len, words.words)) // len(words.words))
            if held > _BYTES:
                yield from out()
                found, held = defaultdict(Counter), 0
        yield from out()

    return _texts(docs).mapInArrow(run, "lang string, words array<string>, starts int, n long")


def graph(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, size, n): edges of ``longest`` words and the shorter ends of pieces; size 0 has the number of words.

    Only what can be part of a phrase counted ``least`` times is kept.
    """
    whole = docs.sparkSession.sparkContext.broadcast(frequent(docs, least))
    phrase = F.explode(F.expr(f"transform(sequence(1, starts), i -> array_join(slice(words, i, {longest}), ' '))"))
    rows = runs(docs, whole, longest).select("lang", phrase.alias("phrase"), "n")
    size = F.when(F.col("phrase") == "", 0).otherwise(
        F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)
    out = written(rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
                  .select("lang", "phrase", size.cast("int").alias("size"), "n"), "graph")
    whole.destroy()
    return out


def _first(phrase: str, k: int):
    return F.substring_index(phrase, " ", k)


def flow(edges: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, size, n): how often every phrase of the graph occurs, level by level from the longest."""
    level = edges.filter(F.col("size") == longest).select("lang", "phrase", "n")
    levels = [level.withColumn("size", F.lit(longest))]
    for k in range(longest - 1, 0, -1):
        ends = edges.filter(F.col("size") == k).select("lang", "phrase", "n")
        level = (level.withColumn("phrase", _first("phrase", k)).unionByName(ends)
                 .groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
        levels.append(level.withColumn("size", F.lit(k)))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return written(out.select("lang", "phrase", "size", "n"), "flow")


def paths(counts: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, path, n, edges): the unary paths of the edges counted ``least`` times; an edge on its own is a path too.

    A node is passed through where an edge into it and an edge out of it both occur as often as the node.
    No path returns to itself: its pieces would never end. A path is no longer than a piece that it is in.
    """
    strong = counts.filter((F.col("size") == longest) & (F.col("n") >= least)).select(
        "lang", F.col("phrase").alias("edge"), "n")
    nodes = counts.filter((F.col("size") == longest - 1) & (F.col("n") >= least)).select(
        "lang", F.col("phrase").alias("node"), "n")
    leaving = strong.withColumn("node", _first("edge", longest - 1)).join(nodes, ["lang", "node", "n"])
    coming = strong.withColumn("node", _first("edge", -(longest - 1))).join(nodes, ["lang", "node", "n"])
    after = coming.select("lang", "node", F.col("edge").alias("head")).join(
        leaving.select("lang", "node", "edge"), ["lang", "node"]).select("lang", "edge", "head")
    hops = written(
        strong.join(after, ["lang", "edge"], "left")
        .select("lang", "edge", "n", F.coalesce("head", "edge").alias("head"),
                F.when(F.col("head").isNull(), 0).otherwise(1).cast("long").alias("at")), "hops")
    while True:
        ahead = hops.select("lang", F.col("edge").alias("head"), F.col("head").alias("_head"), F.col("at").alias("_at"))
        hops = written(
            hops.join(ahead, ["lang", "head"]).select(
                "lang", "edge", "n", F.col("_head").alias("head"), (F.col("at") + F.col("_at")).alias("at"),
                (F.col("_at") > 0).alias("moved")), "hops")
        if hops.filter("moved").isEmpty():
            break
        hops = hops.drop("moved")
    steps = F.sort_array(F.collect_list(F.struct("at", "edge")))
    return hops.groupBy("lang", "head").agg(F.first("n").alias("n"), steps.alias("steps")).select(
        "lang",
        F.concat_ws(" ", "head", F.transform(F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0))),
                                             lambda x: F.substring_index(x["edge"], " ", -1))).alias("path"),
        "n", F.size("steps").cast("long").alias("edges"))


def _inside(found: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase) of the nodes inside paths, which have ``longest`` - 1 words."""
    words = F.split("path", " ")
    starts = F.sequence(F.lit(2), F.col("edges").cast("int"))
    return found.filter("edges > 1").select(
        "lang", F.explode(F.transform(starts, lambda i: F.array_join(F.slice(words, i, longest - 1), " "))).alias("phrase"))


def _widest(counts: DataFrame, chains: DataFrame, least: int, longest: int) -> DataFrame:
    """Phrases of two words or more counted ``least`` times and in no longer phrase that is as frequent."""
    found = counts.filter((F.col("n") >= least) & (F.col("size") > 1))
    left = found.join(_inside(chains, longest), ["lang", "phrase"], "left_anti")
    # Any longer phrase that is as frequent holds one of one word more.
    longer = found.filter("size > 2").select(
        "lang", "n", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"),
                                       F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"))
    return left.join(longer, ["lang", "phrase", "n"], "left_anti")


def scored(wide: DataFrame, counts: DataFrame, total: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) by the cut that scores lowest, of equal ones the first."""
    cuts = (wide.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
            .withColumns({"left": F.expr("substring_index(phrase, ' ', k)"),
                          "right": F.expr("substring_index(phrase, ' ', k - size)")}))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    # 38 digits hold these products exactly.
    score = F.expr("(cast(1000 * cast(n as decimal(17,0)) as decimal(20,0)) * cast(total as decimal(18,0)))"
                   " div (cast(l as decimal(19,0)) * cast(r as decimal(18,0)))")
    return (cuts.join(total, "lang").withColumn("score", score)
            .groupBy("lang", "phrase").agg(
                F.first("n").alias("a"), F.first("total").alias("n"),
                F.min(F.struct("score", "k", "l", "r")).alias("cut"))
            .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``most`` phrases by score."""
    edges = graph(docs, least, longest)
    counts = flow(edges, longest)
    total = edges.filter("size = 0").select("lang", F.col("n").alias("total"))
    wide = _widest(counts, paths(counts, least, longest), least, longest)
    return first_by_score(scored(wide, counts.filter(F.col("n") >= least), total), most)


def first_by_score(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each language. Parts of a language are ranked first, so none is sorted by one task."""
    order = "ORDER BY score DESC, a DESC, phrase"
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = (found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
            .withColumn("_rank", F.expr(f"row_number() OVER (PARTITION BY lang, _part {order})"))
            .filter(F.col("_rank") <= most).drop("_part", "_rank"))
    return (some.withColumn("rank", F.expr(f"cast(row_number() OVER (PARTITION BY lang {order}) as long)"))
            .filter(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
