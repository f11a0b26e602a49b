import duckdb
import pytest

import compare
from conftest import SF_DIR
from llm.conftest import AWKWARD
from termwise.llm import mixing, quality, registry

EXTRA = ["the same line\nthe same line\nother", "a b c a b c a b c x", "x\n\nx\n \nx", "# * $ words and more"]


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_against_sql(spark, name):
    con = compare.connect(SF_DIR)
    assert compare.compare(spark, con, name, registry.QUERIES[name], registry.ORACLES[name], SF_DIR) is None


def sql_over(docs, sql):
    con = duckdb.connect()
    con.register("frame", docs.toPandas())
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, "
                "CAST(source AS VARCHAR) AS source FROM frame")
    cursor = con.execute(sql)
    return compare.normal([c[0] for c in cursor.description], cursor.fetchall())


def test_awkward_quality(spark, documents):
    docs = documents(AWKWARD + EXTRA).drop("lang").withColumnRenamed("n_chars", "n_words")
    rows = quality.apply_policy(quality.apply_policy(quality.ledger(docs), 1, "passes")).collect()
    want = sql_over(docs, registry.OP7_SQL)
    got = compare.normal(
        ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed", "base_failed", "kept"],
        [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.failed, not r.passes, r.kept)
         for r in rows])
    assert got == want
    assert quality.ledger(docs.limit(0)).count() == 0


def test_ablations(spark, documents):
    good = " ".join(f"word{i}" for i in range(60))
    docs = documents([good, good + " #" * 20, "few", "few # # #", None, "again and again and " * 20])
    rows = quality.ledger(docs)
    found = {r.rule: (r.n_failed, r.n_only, r.n_kept, r.n_kept_without) for r in quality.ablations(rows).collect()}
    assert found["symbols"] == (2, 1, 1, 2)
    assert found["few_words"] == (3, 2, 1, 3)
    assert found["repeated_words"] == (1, 1, 1, 2)
    assert quality.apply_policy(rows, 1).filter("kept").count() == 2


@pytest.mark.parametrize("widths", [(256, 1 << 20), (2, 8)])
def test_awkward_mixing(spark, documents, monkeypatch, widths):
    monkeypatch.setattr(mixing, "NARROW", widths[0])
    monkeypatch.setattr(mixing, "WIDE", widths[1])
    rows = [(i * 3 % 41, x, None, ["b", "B", None, "é", "z", ""][i % 6]) for i, x in enumerate(AWKWARD)]
    rows += [(100 + i, "the same copy", None, "hot") for i in range(40)] + [(100, "the same copy", None, "hot")]
    rows += [(None, "no id at all", None, "hot"), (500, None, None, "empty"), (501, "", None, "empty")]
    docs = documents(rows).withColumnRenamed("n_chars", "target")
    mixed = mixing.mix(mixing.with_size(docs)).collect()
    got = compare.normal(["doc_id", "size", "source_size", "target", "taken"],
                         [(r.doc_id, r["size"], r.source_size, r.target, r.copies * r["size"]) for r in mixed])
    assert got == sql_over(docs, registry.OP8_SQL)
    assert all(0 <= r.copies <= 2 for r in mixed)
    total = sum(r["size"] for r in mixed)
    targets = {r.source: (r.target, r.source_size) for r in mixed}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total)
    assert all(t <= 2 * s for t, s in targets.values())
    copies = mixing.emit_copies(mixing.mix(mixing.with_size(docs)))
    assert copies.count() == sum(r.copies for r in mixed)


def reshared(sizes, weights, total):
    """Targets by sharing again and again."""
    targets, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        rest = total - sum(t for i, t in enumerate(targets) if i not in open_)
        share = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        above = {i for i in open_ if share[i] > 2 * sizes[i]}
        for i in above or open_:
            targets[i] = 2.0 * sizes[i] if above else share[i]
        open_ = open_ - above if above else set()
    return targets


def test_targets_by_resharing(spark):
    for sizes in ([100, 10, 10, 5, 400], [1, 1000, 1], [7], [0, 5], [30, 30, 30, 30, 30, 30, 300]):
        df = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(sizes)], "source string, size long")
        got = [r.target for r in mixing.source_targets(df).orderBy("source").collect()]
        want = reshared(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes))
        assert got == pytest.approx(want)


def test_sources_come_near_their_targets(spark):
    rows = registry.op8_mix_sources(spark, "/root/testdata/sf0.1").collect()
    by = {}
    for r in rows:
        taken, _ = by.get((r.target, r.source_size), (0, 0))
        by[r.target, r.source_size] = (taken + r.taken, 0)
    assert all(abs(taken - t) <= 0.02 * t for (t, _), (taken, _) in by.items())
    again = {r.doc_id: r.taken for r in registry.op8_mix_sources(spark, "/root/testdata/sf0.1").collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_mixing_runs_no_python(spark):
    plan = registry.op8_mix_sources(spark, SF_DIR)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_mix_takes_columns_of_any_name(documents):
    docs = documents([(i, "word " * (1 + i % 4), "en", f"s{i % 3}") for i in range(30)])
    for name in ("rate", "shift", "_k", "_start", "_nth", "_rows", "_c0", "level", "weight"):
        docs = docs.withColumn(name, mixing.F.concat(mixing.F.lit(name), "doc_id"))
    for r in mixing.mix(mixing.with_size(docs)).collect():
        assert (r["rate"], r["_k"], r["level"]) == (f"rate{r.doc_id}", f"_k{r.doc_id}", f"level{r.doc_id}")
