"""Nearest neighbours, the divergence audit and vector codes against brute force, and their odd cases."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import codebooks, divergence, forest, queries

VECTORS = "vec_id bigint, embedding array<float>, label int, key string, rep bigint, tree int, score double, v int"


def clustered(n, size, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size))
    return (centres[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, size))).astype(np.float32)


def vectors(spark, x, labels=None):
    rows = [(i, v.tolist(), None if labels is None else labels[i], "k", 1, 2, 0.5, 3) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, VECTORS).repartition(3)


ODD = [(None, [1.0] * 16), (200, None), (201, [0.0] * 16), (202, [float("nan")] + [1.0] * 15), (203, [float("inf")] + [1.0] * 15), (204, [None] + [1.0] * 15), (205, [])]


def odd_vectors(spark):
    rows = [(i, v, None if i == 204 else 1, "k", 1, 2, 0.5, 3) for i, v in ODD]
    return spark.createDataFrame(rows, VECTORS)


def by_brute_force(x, ids, queries, k):
    x, want = x.astype(np.float64), {}
    for q in queries:
        s = (x[ids.index(q)] * x).sum(1)
        want[q] = sorted(((-s[j], i) for j, i in enumerate(ids) if i != q))[:k]
    return want


def listed(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("block,least,queries_at_once", [(4096, 1000, 8192), (16, 20, 5)])
def test_every_neighbour_where_the_audit_asks_for_all(spark, monkeypatch, block, least, queries_at_once):
    """All queries are audited and a recall of 1 is asked for; small blocks make prefixes span and share blocks."""
    monkeypatch.setattr(forest, "BLOCK", block)
    monkeypatch.setattr(forest, "LEAST", least)
    monkeypatch.setattr(forest, "QUERIES", queries_at_once)
    x = clustered(400, 16, 1)
    x[50:90] = x[40]  # more copies than a list holds
    x[100], x[101] = x[40], -x[40]
    found = forest.search(vectors(spark, x).unionByName(odd_vectors(spark)), F.col("vec_id") % 5 == 0, k=7, recall=1.0)
    want = by_brute_force(x, list(range(400)), range(0, 400, 5), 7)
    got = listed(found.found)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], rtol=1e-14)
    assert found.audits[0][1] == 1.0


def test_forest_reaches_its_recall_with_fewer_candidates(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 64)
    monkeypatch.setattr(forest, "LEAST", 30)
    x = clustered(3000, 24, 2) * np.linspace(0.2, 3, 3000, dtype=np.float32)[:, None]  # of many lengths
    found = forest.search(vectors(spark, x), F.col("vec_id") % 20 == 0, k=10)
    (_, recall, need), got = found.audits[0], listed(found.found)
    want = by_brute_force(x, list(range(3000)), range(0, 3000, 20), 10)
    reached = np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want])
    assert recall >= forest.RECALL and reached >= 0.9
    assert need < 3000


def test_search_odd_cases(spark):
    assert forest.search(spark.createDataFrame([], VECTORS), F.col("vec_id") % 2 == 0).found.count() == 0
    assert forest.search(odd_vectors(spark), F.col("vec_id") % 2 == 0).found.count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], 1, "k", 1, 2, 0.5, 3)] * 3, VECTORS)  # repeated rows are one vector
    assert forest.search(one, F.col("vec_id") % 2 == 0).found.count() == 0
    few = one.unionByName(spark.createDataFrame([(1, [1.0, 2.0], 1, "k", 1, 2, 0.5, 3), (2, [1.0], 1, "k", 1, 2, 0.5, 3), (3, [-1.0, 0.0], 1, "k", 1, 2, 0.5, 3)], VECTORS))
    got = [tuple(r) for r in forest.search(few, F.col("vec_id") == 0).found.orderBy("rank").collect()]
    assert got == [(0, 1, 1, 5.0), (0, 2, 3, -1.0)]
    doubles = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e-200, 1e-200]), (2, [3.0, 4.0])], "vec_id int, embedding array<double>")
    got = [(r.vec_id, r.score) for r in forest.search(doubles, F.col("vec_id") == 0).found.orderBy("rank").collect()]
    assert got == [(2, 3e200), (1, 1e200 * 1e-200)]


def plain_codes(rows, parts, entries, rounds, scale):
    """(vec_id, code, error) and all entries, by Lloyd's rounds from scratch in Python's integers."""
    rows = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(rows[0][2]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, _, v in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        codes = [[nearest(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, code in zip(cut, codes, strict=True) if code[p] == k]
                if mine:
                    books[p][k] = tuple(sum(xs) // len(mine) for xs in zip(*mine, strict=True))
    out, by_label = [], Counter()
    for (i, label, _), c in zip(rows, cut, strict=True):
        near = [nearest(p, c[p]) for p in range(parts)]
        error = sum(d for d, _ in near)
        by_label[label] += error
        out.append((i, label, "".join(f"{k:02x}" for _, k in near), error))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter((i, code, error, by_label[label], digest) for i, label, code, error in out)


@pytest.mark.parametrize("n,parts,entries,rounds", [(150, 4, 8, 3), (5, 4, 64, 2), (60, 16, 4, 1)])
def test_codes_as_by_plain_lloyd(spark, n, parts, entries, rounds):
    x = clustered(n, 16, n)
    x[n // 2] = x[0]
    labels = [None if i % 7 == 0 else i % 3 for i in range(n)]
    df = vectors(spark, x, labels).unionByName(odd_vectors(spark))
    df = df.unionByName(df.where("vec_id < 3"))  # repeated rows
    rows = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    got = Counter(tuple(r) for r in codebooks.compressed(df, parts, entries, rounds).collect())
    assert got == plain_codes(rows, parts, entries, rounds, codebooks.SCALE)


def test_codes_odd_cases(spark):
    assert codebooks.compressed(spark.createDataFrame([], VECTORS)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codebooks.compressed(odd_vectors(spark).where("vec_id in (200, 202, 203, 204, 205)")).count() == 0
    zero = codebooks.compressed(odd_vectors(spark).where("vec_id = 201")).collect()
    assert [(r.vec_id, r.code, r.error) for r in zero] == [(201, "00" * 16, 0)]
    big = spark.createDataFrame([(i, [float(i << 15), -1e5, 0.25, 1e-9] * 4, 1) for i in range(9)], "vec_id int, embedding array<double>, label string")
    assert Counter(tuple(r) for r in codebooks.compressed(big, 4, 3, 2).collect()) == plain_codes([(r.vec_id, r.label, r.embedding) for r in big.collect()], 4, 3, 2, 256)
    with pytest.raises(ValueError, match="equal parts"):
        codebooks.compressed(spark.createDataFrame([(1, [1.0, 2.0], 1)], "vec_id int, embedding array<double>, label int"))


def test_only_changes_are_shuffled(spark):
    """The second round's rows are of entries that gained or lost a part, and the running sums are those of all parts."""
    x = clustered(300, 16, 9)
    rows = codebooks.whole_numbers(vectors(spark, x))
    first = rows.orderBy("vec_id").limit(8).collect()
    books = np.array([r.v for r in first], np.int64).reshape(-1, 4, 4).transpose(1, 0, 2)
    one = codebooks._assigned(rows, books)
    sums = codebooks._changes(one, 4, 8, 4)
    named = ["n", "s0", "s1", "s2", "s3"]
    books = codebooks._replaced(books, sums.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in named)))
    two = codebooks._assigned(one, books)
    change = codebooks._changes(two, 4, 8, 4)
    running = sums.unionByName(change).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in named)).where("n <> 0")
    anew = codebooks._changes(two.withColumn("was", F.lit(None).cast("binary")), 4, 8, 4).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in named))
    assert sorted(map(tuple, running.collect())) == sorted(map(tuple, anew.collect()))
    moved = sum(a != b for r in two.collect() for a, b in zip(r.was, r.code, strict=True))
    assert 0 < moved < 300 * 4
    assert change.agg(F.sum(F.abs("n"))).first()[0] <= 2 * moved
    assert change.agg(F.sum("n")).first()[0] == 0


def plain_audit(rows, least, top):
    """The audit from its definition, in Python's integers."""
    found = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = set()
    for lang in {f[0] for f in found}:
        mine = [f[1:] for f in found if f[0] == lang]
        docs = Counter(w for _, ws in mine for w in set(ws))
        kept = sorted(w for w, n in docs.items() if n >= least)
        counts = {s: Counter(w for t, ws in mine if t == s for w in ws) for s in {s for s, _ in mine}}
        whole = sum(counts.values(), Counter())

        def share(c, kept=kept):
            total = sum(c[w] for w in kept) + 5 * len(kept)
            return {w: 1 + math.floor(Fraction(10**9 * (c[w] + 5), total)) for w in kept}

        q, ps = share(whole), {s: share(c) for s, c in counts.items()}
        for s, p in ps.items():
            pairs = [(sum(abs(p[w] - o[w]) for w in kept), t) for t, o in ps.items() if t != s]
            terms = [(p[w] - q[w], w) for w in kept if counts[s][w] and p[w] > q[w]]
            for part, all_, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(all_, key=lambda e: (-e[0], e[1].encode()))[:limit]
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)}
    return out


WORDS = ["Alpha", "alpha", "beta", "Éclair", "éclair", "日本", "x", "a", "b", "aa", "🙂", "straße", "İ"]


def odd_texts(n, sources, seed):
    rng = random.Random(seed)
    for _ in range(n):
        yield rng.choice(["en", "de", None, ""]), rng.choice([*sources, None]), rng.choice([None, "", " 1 2 ", "".join(rng.choice(WORDS) + rng.choice([" ", "  ", "-", "7", "\n", "_", "`"]) for _ in range(rng.randint(1, 30)))])


@pytest.mark.parametrize("sources,small", [(["s", "t"], False), ([f"s{k}" for k in range(9)], True)])
def test_audit_as_by_its_definition(spark, monkeypatch, sources, small):
    if small:
        for name, value in (("TERMS", 2), ("SOURCES", 2), ("AUTOMATON_TERMS", 4)):
            monkeypatch.setattr(divergence, name, value)
    rows = [*odd_texts(120, sources, len(sources)), ("fr", "alone", "1 2 3"), ("fr", "other", None), ("it", "s", "una volta")]
    long = " ".join(random.Random(4).choices(["alpha", "beta", "Gamma"], k=300_000))  # cut several times
    rows += [("en", "s", long)] * 2
    df = spark.createDataFrame([(None if k % 5 == 0 else 1, *r, "t", 5, "p") for k, r in enumerate(rows)], "doc_id bigint, lang string, source string, text string, term string, n int, part string").repartition(3)
    got = [tuple(r) for r in divergence.audit(df, 3, 4).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_audit(rows, 3, 4)


def test_audit_of_odd_tables(spark, odd_docs, no_docs):
    assert divergence.audit(no_docs).count() == 0
    rows = [(r.lang, r.source, r.text) for r in odd_docs.collect()]
    assert {tuple(r) for r in divergence.audit(odd_docs, 1, 50).collect()} == plain_audit(rows, 1, 50)
    assert {r[4] for r in divergence.audit(odd_docs).collect()} <= {0}  # no term is kept


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_vector_codes"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, found.fetchall()))
    assert sorted(names) == sorted(df.columns)
