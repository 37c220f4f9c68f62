"""How the sources of a language differ in their words: a two-pass vocabulary automaton.

The first pass counts in how many documents each term occurs, exactly; the second finds the kept terms again, between
delimiters, with an automaton, and counts them for each source. The counts are sparse: pairs of sources meet in blocks of terms
and sources, where a term that a source lacks has the share that no occurrence gives.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.memory import give_back
from shelfwise.llm.tables import staged

#: Documents of its language that a kept term is in; ranks of the terms of a group.
LEAST_DOCS, TOP_TERMS = 30, 50
SMOOTH, UNIT = 5, 1_000_000_000
#: Terms and bytes of them to an automaton; a larger vocabulary is dealt over several, each of which reads all texts.
AUTOMATON_TERMS, AUTOMATON_BYTES = 400_000, 8 << 20
#: Counts that a task holds before it hands them on, and bytes of text that it cuts at once.
HELD, SLICE = 500_000, 1 << 20
#: Terms, about, whose counts are added up together; terms and sources to a block of the pairs.
RUN, TERMS, SOURCES = 8192, 2048, 64

#: Bytes of UTF-8: letters of ASCII in lower case and all beyond it stay, anything else is a space.
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _slices(data: bytes) -> Iterator[bytes]:
    """The text between spaces, in parts of about SLICE bytes that end at a space."""
    at = 0
    while len(data) - at > SLICE and (end := data.find(b" ", at + SLICE)) >= 0:
        yield data[at:end]
        at = end
    yield data[at:]


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some at a time."""
    for part in _slices(text.translate(_KEEP)):
        yield part.split()


def _grouped(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """(values of `columns`, texts in UTF-8) of a batch, equal values together, so that one group's counts are at hand at a time."""
    keys, texts = list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True)), batch.column("text").cast(pa.binary())
    groups: dict[tuple, list[int]] = defaultdict(list)
    for row, key in enumerate(keys):
        groups[key].append(row)
    for key in sorted(groups):
        yield key, (texts[row].as_py() for row in groups[key])


def _joined(texts: Iterator[bytes]) -> Iterator[bytes]:
    """Texts between spaces, short ones together, about SLICE bytes at a time."""
    held, size = [], 0
    for text in texts:
        for part in _slices(text.translate(_KEEP)):
            held.append(part)
            size += len(part)
            if size >= SLICE:
                yield b" %b " % b" ".join(held)
                held, size = [], 0
    yield b" %b " % b" ".join(held)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, docs): the number of documents of a language that hold a term."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            langs, terms, counts = [], [], []
            for lang, c in held.items():
                langs += [lang] * len(c)
                terms += c.keys()
                counts += c.values()
            held.clear()
            return pa.record_batch([pa.array(langs, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "term", "docs"])

        for b in batches:
            for (lang,), texts in _grouped(b, "lang"):
                for text in texts:
                    held[lang].update(set().union(*terms_of(text)))
            if sum(map(len, held.values())) > HELD:
                yield out()
        yield out()
        give_back()

    parts = _rows(docs).select("lang", "text").mapInArrow(counted, "lang string, term string, docs bigint")
    return parts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def _numbered(kept: DataFrame) -> DataFrame:
    """(lang, term, number): runs of about RUN terms, by hash; a number's low 32 bits are the place in its run."""
    runs = max(1, kept.count() // RUN)
    run = F.pmod(F.xxhash64("lang", "term"), F.lit(runs))
    place = F.row_number().over(Window.partitionBy("run").orderBy("lang", "term")) - 1
    return kept.withColumn("run", run).withColumn("number", F.shiftleft("run", 32) + place).drop("run")


def _automata(terms: dict[str, list[tuple[bytes, int]]]) -> dict:
    """An automaton for each language, over its terms between delimiters; a byte is a letter of it."""
    import ahocorasick

    found = {}
    for lang, words in terms.items():
        found[lang] = a = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for word, number in words:
            a.add_word(f" {word.decode('latin-1')} ", number)
        a.make_automaton()
    return found


def _occurrences(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, run, at, n): parts of the counts of the terms in `kept`, which fit one automaton. A row has the counts of a
    run of numbers, those that are not 0: `at` their places in it, `n` the counts."""
    terms: dict[str, list[tuple[bytes, int]]] = defaultdict(list)
    for lang, word, number in kept.select("lang", F.col("term").cast("binary"), "number").toPandas().itertuples(index=False):  # AUTOMATON_TERMS, about
        terms[lang].append((bytes(word), number))
    shared = docs.sparkSession.sparkContext.broadcast(dict(terms))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata, held = _automata(shared.value), defaultdict(Counter)

        def out() -> pa.RecordBatch:
            rows = []
            for (lang, source), c in held.items():
                numbers, n = (np.fromiter(x, np.int64, len(c)) for x in (c.keys(), c.values()))
                order = np.argsort(numbers)
                numbers, n = numbers[order], n[order]
                for some in np.split(np.arange(len(c)), np.flatnonzero(np.diff(numbers >> 32)) + 1):
                    if len(some):
                        rows.append((lang, source, int(numbers[some[0]] >> 32), numbers[some].astype("<u4").tobytes(), n[some].astype("<i8").tobytes()))
            held.clear()
            return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()))], ["lang", "source", "run", "at", "n"])

        for b in batches:
            for (lang, source), texts in _grouped(b, "lang", "source"):
                if lang in automata:
                    for part in _joined(texts):
                        held[lang, source].update(map(itemgetter(1), automata[lang].iter(part.decode("latin-1"))))
            if sum(map(len, held.values())) > HELD:
                yield out()
        yield out()
        give_back()

    return _rows(docs).mapInArrow(counted, "lang string, source string, run bigint, at binary, n binary")


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of rows that stand next to each other with equal (lang, source, run); only one run is held."""
    total, last = np.zeros(0, np.int64), None

    def out() -> pa.RecordBatch:
        at = np.flatnonzero(total)
        lang, source, run = last
        return pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), pa.array((run << 32) + at, pa.int64()), pa.array(total[at], pa.int64())], ["lang", "source", "number", "n"])

    for b in batches:
        for *key, at, n in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "run", "at", "n")), strict=True):
            if key != last:
                if last is not None:
                    yield out()
                    total[:] = 0
                last = key
            places = np.frombuffer(at, "<u4")
            if places[-1] >= len(total):
                total = np.append(total, np.zeros(places[-1] + 1, np.int64))
            total[places] += np.frombuffer(n, "<i8")
    if last is not None:
        yield out()


def postings(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, number, n): how often each of the terms (lang, term, number) occurs in each source, where it does."""
    n, size = kept.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
    blocks = max(1, math.ceil(n / AUTOMATON_TERMS), math.ceil((size or 0) / AUTOMATON_BYTES))
    parts = None
    for k in range(blocks):
        one = _occurrences(docs, kept.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k))
        parts = one if parts is None else parts.unionByName(one)
    keys = ["lang", "source", "run"]
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_added_up, "lang string, source string, number bigint, n bigint")


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * kept)) in whole decimals; 0 where nothing is kept."""
    top, below = F.lit(UNIT).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(19,0)"), (total + SMOOTH * kept).cast("decimal(19,0)")
    return F.when(kept > 0, 1 + ((top - top % below) / below).cast("long")).otherwise(F.lit(0).cast("long"))


def _pair_sums(key, terms: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sources of two blocks over the terms of a block: for each pair, how much the shares differ."""
    _, block, i, j = key
    groups = groups.sort_values("source", ignore_index=True)
    names, none, own = groups.source.to_numpy(object), groups.none.to_numpy(), groups.own.to_numpy()
    row = pd.Index(names).get_indexer(terms.source)
    column, seen = pd.factorize(terms.number)
    shares = np.repeat(none[:, None], len(seen), axis=1)
    shares[row, column] = terms.share.to_numpy()
    kept = int(groups.kept.iloc[0]) if len(groups) and block == 0 else 0
    out = []
    for a in np.flatnonzero(own == i):
        others = np.flatnonzero((own == j) & ((i != j) | (np.arange(len(own)) > a)))
        apart = np.abs(none[others] - none[a])
        sums = np.abs(shares[others] - shares[a]).sum(1) + (kept - len(seen)) * apart
        out += zip([key[0]] * len(others), [names[a]] * len(others), names[others], sums.tolist(), strict=True)
    return pd.DataFrame(out, columns=["lang", "a", "b", "value"], dtype=object)


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of every two sources of a language: the shares' differences summed over all kept terms. A term
    that neither has differs by what no occurrence gives, so terms that a block lacks are counted, not listed."""
    sizes = staged(groups.groupBy("lang").agg(F.ceil(F.max("kept") / TERMS).alias("cuts"), F.ceil(F.count("*") / SOURCES).alias("heaps")), "audit-sizes")
    own = F.pmod(F.xxhash64("source"), F.col("heaps"))
    block = F.pmod(F.xxhash64("number"), F.greatest(F.col("cuts"), F.lit(1)))

    def met(rows: DataFrame) -> DataFrame:
        spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("heaps") - 1)))
        return spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "heaps", "cuts")

    left = met(shares.join(sizes, "lang").select("lang", "source", "number", "share", block.alias("block"), own.alias("own"), "heaps"))
    right = groups.join(sizes, "lang").withColumn("own", own).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("cuts") - 1, F.lit(0)))))
    right = met(right.select("lang", "source", "none", "kept", "block", "own", "heaps", "cuts"))
    keys = ["lang", "block", "i", "j"]
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_pair_sums, "lang string, a string, b string, value bigint")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank). Part "pair": each other source of the language by how far its shares of the
    kept terms are from the group's, all of them. Part "term": the kept terms that the group has and uses more than
    its language, the first `top`. Greater values first, ties by the item's UTF-8.

    Terms are runs of ASCII letters, in lower case, and of characters beyond ASCII, as they are. A language keeps the terms that
    `least_docs` of its documents hold. A share is 1 + floor(10^9 (n + 5) / (N + 5 V)), where N counts the group's
    occurrences of the V kept terms. Every row is a document, repeated ids too; null texts, languages and sources are empty. A
    group without terms has its pairs; a language that keeps none has pairs of value 0. Without rows the result is
    empty. Other columns are left out.
    """
    kept = staged(document_frequencies(docs).where(F.col("docs") >= least_docs).select("lang", "term"), "audit-kept")
    kept = staged(_numbered(kept), "audit-terms")
    counts = staged(postings(docs, kept), "audit-counts")
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = _rows(docs).select("lang", "source").distinct().join(vocabulary, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("kept", "total")))
    groups = staged(groups.withColumn("none", _share(F.lit(0), F.col("total"), F.col("kept"))), "audit-groups")
    shares = counts.join(groups, ["lang", "source"]).select("lang", "source", "number", _share(F.col("n"), F.col("total"), F.col("kept")).alias("share"))
    shares = staged(shares, "audit-shares")

    pairs = staged(_pairs(shares, groups), "audit-pairs")
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("p"), "value").select("lang", "p.*", "value")

    whole = counts.groupBy("lang", "number").agg(F.sum("n").alias("n"))
    overall = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kept").alias("kept"))
    usual = whole.join(overall, "lang").select("number", _share(F.col("n"), F.col("total"), F.col("kept")).alias("usual"))
    more = shares.join(usual, "number").where("share > usual").withColumn("value", F.col("share") - F.col("usual"))
    more = more.join(kept.select("number", F.col("term").alias("item")), "number").select("lang", "source", "item", "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    ranked = pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).select(*columns)
    return ranked.unionByName(more.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term")).select(*columns))


def _share_sql(n: str, total: str) -> str:
    return f"1 + cast(cast({UNIT} as hugeint) * ({n} + {SMOOTH}) // ({total} + {SMOOTH} * v.kept) as bigint)"


SQL = rf"""
with rows_ as (select row_number() over () rid, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') body from documents),
    words as (select rid, lang, source, translate(unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') term from rows_),
    terms as (select lang, term from words group by 1, 2 having count(distinct rid) >= {LEAST_DOCS}),
    vocabulary as (select lang, count(*) kept from terms group by 1),
    counts as (select w.lang, w.source, w.term, count(*) n from words w join terms t on w.lang = t.lang and w.term = t.term group by 1, 2, 3),
    groups as (select distinct lang, source from rows_),
    totals as (select g.lang, g.source, coalesce(sum(c.n), 0) total from groups g left join counts c on g.lang = c.lang and g.source = c.source group by 1, 2),
    shares as (
        select s.lang, s.source, t.term, coalesce(c.n, 0) n, {_share_sql("coalesce(c.n, 0)", "s.total")} p
        from totals s join terms t on s.lang = t.lang join vocabulary v on s.lang = v.lang
        left join counts c on c.lang = s.lang and c.source = s.source and c.term = t.term),
    sums as (select lang, term, sum(n) n from counts group by 1, 2),
    usual as (
        select t.lang, t.term, {_share_sql("t.n", "(select sum(n) from counts c where c.lang = t.lang)")} q
        from sums t join vocabulary v on t.lang = v.lang),
    apart as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
    pairs as (
        select a.lang, a.source, 'pair' part, b.source item, cast(coalesce(f, 0) as bigint) f
        from groups a join groups b on a.lang = b.lang and a.source <> b.source left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source),
    more as (select s.lang, s.source, 'term' part, s.term item, s.p - u.q f from shares s join usual u on s.lang = u.lang and s.term = u.term where s.n > 0 and s.p > u.q),
    ranked as (select *, row_number() over (partition by lang, source, part order by f desc, item) rank from (select * from pairs union all select * from more))
select lang, source, part, item, cast(f as bigint) "value", cast(rank as integer) rank from ranked where part = 'pair' or rank <= {TOP_TERMS}"""
