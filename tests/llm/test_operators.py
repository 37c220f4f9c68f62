"""Each operator against a brute-force version, and over odd and empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwise.llm import chat, components, fingerprints, mixing, near_dups, neighbours, packing, quality, suffixes, tokens, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def rows(df):
    return [r.asDict() for r in df.collect()]


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def tops(links, ids):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


# --- 1 quality


LINES = ["The cat sat on the mat and looked about.", "It was a fine day, and all was well.", "Nobody said a word for some time."]
JUNK = ["$$$ ### buy %%% now &&& ***", "| home | about | login | cart |", "spam spam spam spam spam spam"]


def labelled(spark, make, column, n=400):
    rng = random.Random(5)
    docs = [(k, make(rng, k % 4 == 0)) for k in range(n)]
    labels = [(k, int((k % 4 == 0) == (column == "toxic"))) for k in range(n) if k % 10]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, f"doc_id bigint, {column} int")


def test_quality(spark, odd_docs, no_docs):
    docs, labels = labelled(spark, lambda rng, bad: "\n".join(rng.choices(JUNK if bad else LINES, k=rng.randint(1, 8))), "quality")
    out = rows(quality.scores(docs, labels))
    assert len(out) == 400
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3) == int(r["doc_id"] % 4 != 0)
    odd = rows(quality.scores(odd_docs, labels))
    assert len(odd) == 10 and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.scores(no_docs, labels).count() == 0
    assert {r["score"] for r in rows(quality.scores(docs, labels.limit(0)))} == {0.5}


def test_quality_learns_from_late_lines():
    import pandas as pd

    rng = random.Random(2)
    texts = ["\n".join([*rng.choices(LINES, k=40), *rng.choices(JUNK if k % 2 else LINES, k=40)]) for k in range(60)]
    field = quality.Field(pd.DataFrame({"doc_id": range(60), "text": texts, "label": [1 - k % 2 for k in range(60)]}))
    clean, junk = (field.bad_share("\n".join(rng.choices(some, k=20))) for some in (LINES, JUNK))
    assert clean < 0.1 and junk > 0.9
    assert quality._whole_documents(["a\nb"] * 10, 7).size == 3


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(1)
    emit, move = rng.normal(size=(1, 5, 2)), rng.normal(size=(2, 2))
    weight = np.zeros((5, 2))
    for code in range(32):
        states = [code >> t & 1 for t in range(5)]
        w = math.exp(sum(emit[0, t, s] for t, s in enumerate(states)) + sum(move[a, b] for a, b in zip(states, states[1:])))
        for t, s in enumerate(states):
            weight[t, s] += w
    want = weight[:, 1] / weight.sum(1)
    assert np.allclose(quality.marginals(emit, np.array([5]), move)[0][0], want)
    assert np.allclose(quality.bad_marginals(emit[..., 1] - emit[..., 0], np.array([5]), move)[0], want)


def test_quality_score_is_that_of_all_labellings(monkeypatch):
    import pandas as pd

    rng = random.Random(3)
    texts = ["\n".join(rng.choices(JUNK if k % 2 else LINES, k=rng.randint(1, 6))) for k in range(80)]
    field = quality.Field(pd.DataFrame({"doc_id": range(80), "text": texts, "label": [1 - k % 2 for k in range(80)]}))
    monkeypatch.setattr(quality, "LINES_AT_ONCE", 2)
    for text in ["\n".join(rng.choices(JUNK + LINES, k=7)), "", "one line"]:
        length, x = quality.line_features(text)
        odds, weight, total = x.astype(float) @ field.w, np.zeros(len(x)), 0.0
        for code in range(1 << len(x)):
            states = [code >> t & 1 for t in range(len(x))]
            w = math.exp(sum(odds[t] for t, s in enumerate(states) if s) + sum(field.move[a, b] for a, b in zip(states, states[1:])))
            weight, total = weight + w * np.array(states), total + w
        share = min(max((weight / total * length).sum() / length.sum(), 1e-4), 1 - 1e-4)
        want = 1 / (1 + math.exp(-(field.slope * math.log(share / (1 - share)) + field.offset)))
        assert field.quality(np.array([field.bad_share(text)]))[0] == pytest.approx(want, abs=1e-5)


def test_quality_of_very_many_lines():
    field = quality.Field(__import__("pandas").DataFrame({"doc_id": [1, 2], "text": ["\n".join(LINES), "\n".join(JUNK)], "label": [1, 0]}))
    clean, junk = ("\n".join(some * 170_000) for some in (LINES, JUNK))
    assert field.bad_share(clean) < 0.5 < field.bad_share(junk)


# --- 2 suffixes


def removed(docs):
    first = {}
    known = [(suffixes._NULL_ID if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in sorted(known):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = []
    for (i, b), (doc, _) in zip(known, docs):
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def in_order(found):
    return sorted(found, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("chunk_bytes", [3_000, 1 << 20])
def test_suffixes(corpus, chunk_bytes):
    out = [tuple(r) for r in suffixes.removed_passages(corpus, chunk_bytes).collect()]
    assert in_order(out) == in_order(removed(pairs(corpus)))


def test_suffixes_odd(spark, odd_docs, no_docs, monkeypatch):
    out = [tuple(r) for r in suffixes.removed_passages(odd_docs).collect()]
    assert in_order(out) == in_order(removed(pairs(odd_docs)))
    assert suffixes.removed_passages(no_docs).count() == 0 and suffixes.without_repeats(no_docs).columns == no_docs.columns
    kept = suffixes.without_repeats(odd_docs)
    assert kept.columns == odd_docs.columns and in_order(pairs(kept)) == in_order(pairs(odd_docs))


def test_hot_grams_and_short_periods():
    rng = random.Random(2)
    core = "".join(rng.choices("abcd", k=70))
    docs = [(k, "".join(rng.choices("abcd", k=30)) + core + "".join(rng.choices("abcd", k=30))) for k in range(40)] + [(90 + k, "ab" * (40 + k)) for k in range(5)]
    import pyarrow as pa

    table = pa.table({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    blob = sink.getvalue().to_pybytes()
    c = suffixes.Chunk(blob)
    c.anchors()
    grams = len(c.fingerprints()[0])
    hashes, ids = suffixes._first_ids(c)
    for kind in (suffixes._MIXED, suffixes._HOT):
        runs = suffixes._run(1, blob, np.full(grams, kind, np.uint8), ids)
        blocks = runs[runs.base >= 0]
        found = suffixes._merge_range([])((0,), blocks)
        answers = [np.frombuffer(suffixes.zstandard.decompress(b), suffixes._ANSWER) for b in found.answers]
        head = runs[runs.base < 0].iloc[0]
        gone = suffixes._removed(c, np.frombuffer(suffixes.zstandard.decompress(head.postings), suffixes._POSTING), np.concatenate(answers), suffixes._unpack(head.copies, "u1"))
        got = [int(gone[a:b].sum()) for a, b in zip(c.starts, c.starts[1:])]
        assert got == [r[2] for r in removed(docs)]


def test_grams_are_counted_far_over_hot_and_spread_over_buckets():
    import pyarrow as pa

    rng = random.Random(5)
    core = "".join(rng.choices("abcd", k=20))
    many = suffixes.HOT + 500
    texts = ["".join(rng.choices("efgh", k=40)) + core + "".join(rng.choices("efgh", k=40)) for _ in range(many)]
    table = pa.table({"doc_id": list(range(many)), "text": texts})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    c = suffixes.Chunk(sink.getvalue().to_pybytes())
    c.anchors()
    grams, _, counts, _ = c.fingerprints()
    at = [c.data[p : p + 20].decode() for p in c.at.tolist()]
    assert (counts & suffixes._MANY).max() == max(Counter(at).values())
    assert np.bincount((grams >> np.uint64(60)).astype(int), minlength=16).max() < 2 * len(grams) / 16


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 20])
def test_steps_cover_all_strings(step, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "STEP", step)
    rng = random.Random(step)
    texts = ["".join(rng.choices("abc", k=n)) for n in (0, 49, 50, 51, 200, 10, 90)]
    table = pa.table({"doc_id": list(range(7)), "text": texts})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    c = suffixes.Chunk(sink.getvalue().to_pybytes())
    c.anchors()
    starts = [p for a, b in zip(c.low, c.high) for p in range(a, b + 1)]
    assert starts == [p for k in range(7) for p in range(c.starts[k], c.starts[k + 1] - 49)]
    assert all(b <= at <= a + 30 for a, at, b in zip(c.low, c.at, c.high))


def test_merge_keeps_prefixes():
    rng = random.Random(4)
    for _ in range(200):
        runs = []
        for _ in range(rng.randint(1, 9)):
            ss = sorted("".join(rng.choices("ab", k=rng.randint(0, 6))).encode() for _ in range(rng.randint(0, 20)))
            runs.append((ss, [0, *map(suffixes.common_prefix, ss, ss[1:])][: len(ss)]))
        out = list(suffixes.merged_runs(runs))
        assert [s for *_, s in out] == sorted(s for ss, _ in runs for s in ss)
        assert all(b[0] == suffixes.common_prefix(a[3], b[3]) for a, b in zip(out, out[1:]))


# --- 3 toxicity


def test_toxicity(spark, odd_docs, no_docs):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]

    def make(r, bad):
        ws = r.choices(vocabulary, k=40)
        return " ".join([*ws, *r.choices(["vile", "awful", "nasty"], k=3)] if bad else ws)

    docs, labels = labelled(spark, make, "toxic")
    out = rows(toxicity.scores(docs, labels))
    held = [r for r in out if r["held_out"]]
    assert len(out) == 400 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.95
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {r["doc_id"] for r in out if not r["predicted"]}
    assert len(rows(toxicity.scores(odd_docs, labels))) == 10 and toxicity.scores(no_docs, labels).count() == 0
    assert {r["score"] for r in rows(toxicity.scores(odd_docs, labels.limit(0)))} == {0.0}


@pytest.mark.parametrize("common", [0.02, toxicity.COMMON, 1.0])
def test_block_max_search_is_exact(common):
    import pandas as pd

    rng = random.Random(1)
    bad, good = ["vile", "awful", "nasty", "rotten"], ["fine", "lovely", "kind", "gentle"]
    texts = [" ".join([*rng.choices(bad if k % 2 else good, k=rng.randint(1, 6)), f"w{k}", f"v{k}"]) for k in range(300)]
    index = toxicity.Index(pd.DataFrame({"doc_id": range(300), "text": texts, "label": [k % 2 for k in range(300)]}), neighbours=7, block=4, common=common)
    vectors = {}
    for i, (es, ws) in index.postings.items():
        for e, w in zip(es, ws):
            vectors.setdefault(e, {})[i] = w
    for text in ["vile awful kind", "fine", "", "nasty nasty nasty lovely"]:
        counts = index.counts(text)
        q = dict(zip(*map(np.ndarray.tolist, index.vector(counts))))
        cosines = np.array([sum(w * q.get(i, 0) for i, w in vectors[e].items()) for e in range(len(index.votes))])
        order = np.argsort(-cosines, kind="stable")
        last = cosines[order[np.searchsorted(np.cumsum(index.votes[order, 0]), 7)]]
        es, _ = index.nearest(counts)
        assert set(es.tolist()) == set(np.flatnonzero(cosines >= last - 1e-9).tolist())


def test_toxicity_counts_repeated_sentences_and_every_word():
    import pandas as pd

    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    said = "zorb quell mudge fipple trask"
    texts = [" ".join([*rng.choices(vocabulary, k=30), *([said] if k % 4 == 0 else [])]) for k in range(400)]
    index = toxicity.Index(pd.DataFrame({"doc_id": range(400), "text": texts, "label": [int(k % 4 == 0) for k in range(400)]}))
    assert set(said.split()) <= set(index.terms)  # the inner words of a sentence repeated word by word count, too
    assert index.score("quell mudge fipple")[0] > 0.7 > index.score(" ".join(rng.choices(vocabulary, k=30)))[0]
    for text in texts[:20]:  # each word has a place of its own, and its own text is the nearest
        assert len(set(index.counts(text)[0].tolist()) - set(index.terms.values())) == len(set(text.split()))
        assert index.nearest(index.counts(text))[1][0] == pytest.approx(1) and index.score(text)[1][0] == texts.index(text)


def test_toxicity_score_is_that_of_brute_force():
    """Vectors, neighbours and votes from the texts themselves, and the calibration from the votes."""
    import pandas as pd

    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(60)]
    texts = [" ".join([*rng.choices(vocabulary, k=rng.randint(1, 30)), *(rng.choices(["vileness", "awful", "fine"], k=2) if k % 3 else ["nasty"])]) for k in range(90)]
    texts += texts[:15]
    labels = [int(k % 105 % 90 % 3 == 0) for k in range(105)]
    index = toxicity.Index(pd.DataFrame({"doc_id": range(105), "text": texts, "label": labels}), neighbours=9, block=4)
    n = len(texts)

    def bag(text):
        ws = text.lower().split()
        every = Counter(ws)
        told = Counter(t for w in ws for t in [w, *(w[:k] + "*" for k in (4, 5, 7) if len(w) > k)] if t in index.terms)
        return told, every

    bags = [bag(t) for t in texts]
    df = [Counter(t for b in bags for t in b[k]) for k in (0, 1)]
    toxic = Counter(t for b, y in zip(bags, labels) if y for t in b[0])
    telling = lambda t: math.log2(2 + toxic[t] / max(1, df[0][t] - toxic[t]))
    weigh = lambda b, k: {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[k][t])) + 1) * (1 if k else telling(t)) for t, c in b.items()}

    def vector(b):
        told, every = weigh(b[0], 0) | {"": toxicity.OTHER}, weigh(b[1], 1)
        out = {}
        for k, (part, share) in enumerate(((told, toxicity.TELLING), (every, 1 - toxicity.TELLING))):
            size = math.sqrt(sum(x * x for x in part.values()) / share) if part else 1
            out |= {(k, t): x / size for t, x in part.items()}
        return out

    vectors = [vector(b) for b in bags]

    def vote(v, but=None):
        sims = sorted(((sum(x * u.get(t, 0) for t, x in v.items()), labels[i]) for i, u in enumerate(vectors) if i != but), reverse=True)
        some = [(s, y) for s, y in sims if s >= sims[8][0] - 1e-9]
        w = [1 / (0.05 + max(0, 1 - s)) for s, _ in some]
        return sum(x * y for x, (_, y) in zip(w, some)) / sum(w)

    own = [vote(v, i) for i, v in enumerate(vectors)]
    for text in [*texts[:10], "vileness awful zzz", "", "strange words only"]:
        v = vote(vector(bag(text)))
        assert index.vote(index.counts(text))[0] == pytest.approx(v)
        level = np.interp(v, index.cuts, index.levels)
        assert index.score(text)[0] == pytest.approx(0.99 * level + 0.01 * v)
    # the calibration: isotonic, and as many toxic examples as there are
    at = np.searchsorted(index.cuts, np.array(own) - 1e-9)
    assert (np.diff(index.levels) > -1e-12).all()
    for k, level in enumerate(index.levels):
        ys = [labels[i] for i in range(n) if at[i] == k]
        assert level == pytest.approx((sum(ys) + 0.05) / (len(ys) + 0.1))


# --- 4 chat


def test_chat(spark):
    rng = random.Random(6)
    bits = ["<|", "\\", "</s>", "[INST]", "<|end|>", "<|turn|>", "hello", "\n", "<", "é🙂"]
    said = [(c, t, rng.choice(["user", "assistant", "system"]), None if rng.random() < 0.1 else "".join(rng.choices(bits, k=rng.randint(0, 6)))) for c in range(60) for t in range(rng.randint(1, 7))]
    said += [(None, 0, None, None), (None, 1, "assistant", "x"), (5, None, "assistant", "late"), (7, 0, "user", "twice"), (7, 0, "user", "twice")]
    df = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    by = defaultdict(list)
    for c, t, r, x in said:
        by[c].append((math.inf if t is None else t, r or "", x or ""))
    alone = sorted(r["n_turns"] for r in rows(chat.read_back(df)) if r["conv_id"] is None)
    assert alone == [1, 1] and by.pop(None)  # rows without an id are conversations of their own
    df = df.where("conv_id is not null")
    out = {r["conv_id"]: r for r in rows(chat.read_back(df))}
    examples = defaultdict(list)
    for e in rows(chat.training_examples(df)):
        examples[e["conv_id"]].append(e)
    assert set(out) == set(by)
    for c, turns in by.items():
        turns = [(r, x) for _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        assert out[c]["n_turns"] == len(turns)
        assert out[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (out[c]["loss_chars"], out[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        es = sorted(examples[c], key=lambda e: e["example"])
        assert out[c]["formatted_chars"] == sum(len(e["text"]) for e in es)
        trained = [e for e in es if e["loss_start"] >= 0]
        assert len(trained) == sum(r == "assistant" for r, _ in turns)
        for e in trained:
            assert chat.parse(e["text"]) == turns[: e["n_context"] + 1]
            assert chat.unescape(e["text"][e["loss_start"] : e["loss_end"]]) == turns[e["n_context"]][1]
    assert chat.read_back(df.limit(0)).count() == 0
    packed = rows(chat.packed_examples(df))
    longest = {e["conv_id"]: e["text"] for e in packed if e["text"] is not None}
    assert set(longest) == set(by)
    written = {(e["conv_id"], e["example"]): e for es in examples.values() for e in es}
    for e in packed:
        other = written[e["conv_id"], e["example"]]
        assert longest[e["conv_id"]][: e["length"]] == other["text"]
        assert (e["loss_start"], e["loss_end"], e["n_context"]) == (other["loss_start"], other["loss_end"], other["n_context"])
    wrong = chat.packed_examples(df.where("conv_id = 7")).withColumn("loss_end", F.col("loss_end") - F.when(F.col("loss_end") > 0, 1).otherwise(0))
    if any(r == "assistant" for r, _ in [(r, x) for _, r, x in by[7]]):
        with pytest.raises(Exception, match="loss span"):
            rows(chat.read_examples(wrong))


def test_chat_of_a_very_long_conversation_and_other_columns(spark):
    """20 MB in 4,000 turns, whose contexts written out would be 20 GB; columns named like those made inside."""
    body = "word <|turn|> \\ [INST] " * 200
    schema = "conv_id int, turn int, role string, text string, example int, length string, loss_start int"
    said = [(1, t, "assistant" if t % 2 else "user", f"{t} {body}", 5, "x", 6) for t in range(4_000)] + [(2, 0, "assistant", None, None, None, None)]
    out = {r["conv_id"]: r for r in rows(chat.read_back(spark.createDataFrame(said, schema).repartition(4)))}
    loss = "".join(x for c, _, r, x, *_ in said if r == "assistant" and c == 1)
    assert out[1]["n_turns"] == 4_000 and out[1]["loss_chars"] == len(loss)
    assert out[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert out[1]["formatted_chars"] > 2_000 * len(loss)
    assert (out[2]["n_turns"], out[2]["loss_chars"]) == (1, 0)


# --- 5 neighbours


def test_lists_of_links_only_are_saturated_at_any_length(spark):
    sims = {1: [0.99] * 30, 2: [0.99] * 48, 3: [0.99] * 47 + [0.9], 4: []}
    lists = spark.createDataFrame([(v, [(x, 100 + j) for j, x in enumerate(xs)], 48) for v, xs in sims.items()], "vec_id bigint, near array<struct<sim:double,id:bigint>>, k int")
    assert {r["vec_id"] for r in rows(neighbours.saturated(lists, 0.95))} == {1, 2}


def test_a_round_of_the_descent_makes_its_edges_once(spark):
    """Both sides of the local join came from one recipe that was run twice, and old and new lists met once more to be counted."""
    x = np.random.default_rng(3).normal(size=(40, 4))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    sims = unit @ unit.T
    near = lambda i, js: sorted([(float(sims[i, j]), j) for j in js], reverse=True)
    rows = [(i, near(i, [j % 40 for j in (i + 1, i + 2, i + 3)]), 3) for i in range(40)]
    lists = neighbours.staged(spark.createDataFrame(rows, "vec_id bigint, near array<struct<sim:double,id:bigint>>, k int"), "lists")
    found, around = neighbours._descend(vectors, lists, 4)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    proposed = {r.vec_id: {e.id: e.sim for e in r.near} for r in found.groupBy("vec_id").agg(F.flatten(F.collect_list("near")).alias("near")).collect()}
    new, changed, doubled = neighbours._with_proposals(lists, found, 2.0)
    neighbours.drop(around)
    want = {i: sorted({*old, *((s, j) for j, s in proposed.get(i, {}).items())}, reverse=True)[:3] for i, old, _ in rows}
    assert {r.vec_id: [(e.sim, e.id) for e in r.near] for r in new.collect()} == want
    assert changed == sum(len({j for _, j in want[i]} - {j for _, j in old}) for i, old, _ in rows) > 0 == doubled


def test_lists_are_made_by_brute_force_if_the_audit_fails(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = [c + 0.05 * rng.normal(size=16) for c in rng.normal(size=(40, 16)) for _ in range(4)]
    vectors = spark.createDataFrame([(k, e.tolist()) for k, e in enumerate(x)], "vec_id bigint, embedding array<double>")
    asked = []
    monkeypatch.setattr(neighbours, "audited_recall", lambda *a: asked.append(1) or 0.5)
    lists = neighbours.neighbour_lists(vectors, 160, rounds=2, forests=1)
    assert asked
    u = np.stack(x) / np.linalg.norm(x, axis=1, keepdims=True)
    for r in lists.collect():
        sims = u @ u[r["vec_id"]]
        assert {e["id"] for e in r["near"] if e["sim"] >= 0.95} == set(np.flatnonzero(sims >= 0.95)) - {r["vec_id"]}


def test_recall_is_a_mean_over_vectors_with_links(spark):
    lists = spark.createDataFrame([(1, [(0.99, 2), (0.97, 3)], 12), (2, [(0.99, 1)], 12), (7, [(0.5, 1)], 12)], "vec_id bigint, near array<struct<sim:double,id:bigint>>, k int")
    truth = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 3), (7, 8)], "a bigint, b bigint")
    assert neighbours.audited_recall(lists, truth, 0.95) == pytest.approx(0.5)
    assert neighbours.audited_recall(lists, truth.limit(0), 0.95) == 1.0


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = [c + 0.12 * rng.normal(size=16) for c in centres for _ in range(6)] + list(rng.normal(size=(120, 16)))
    hub = rng.normal(size=16)
    x += [hub + 0.14 * rng.normal(size=16) for _ in range(150)]
    given = [(k, [float(np.float32(v)) for v in e]) for k, e in enumerate(x)]
    given += [(1000 + k, given[0][1]) for k in range(5)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] * 8), (2004, []), (None, given[3][1]), (2005, [1.0, 2.0]), (2006, [2.0, 4.0])]
    df = spark.createDataFrame([(i, e, 1, "k") for i, e in given], "vec_id bigint, embedding array<float>, part int, key string").repartition(4)
    out = {r["vec_id"]: r for r in rows(neighbours.near_vectors(df))}
    good = [(i, np.array(e, float) / np.linalg.norm(e)) for i, e in given if i is not None and (i < 2000 or i > 2004)]
    links = [(i, j) for k, (i, a) in enumerate(good) for j, b in good[:k] if len(a) == len(b) and a @ b >= 0.95]
    want = tops(links, [i for i, _ in given if i is not None])
    degree = Counter(i for link in links for i in link)
    assert set(out) == set(want) and max(degree.values()) > neighbours.LIST
    found = sum(out[i]["n_links"] for i in want)
    assert all(out[i]["n_links"] <= degree[i] for i in want) and found >= 0.99 * sum(degree.values())
    assert np.mean([out[i]["component_id"] == want[i] for i in want]) > 0.99
    assert all(out[i]["kept"] == (out[i]["component_id"] == i) for i in want)
    assert neighbours.near_vectors(df.limit(0)).count() == 0


def test_vectors_whose_squares_are_not_finite(spark):
    given = [(0, [1e200, 1e200, 0.0]), (1, [1e-200, 1.01e-200, 0.0]), (2, [1e300, -1e300, 1.0]), (3, [5e-324, 0.0, 0.0]), (4, [1.0, 1.0, 0.0])]
    out = {r["vec_id"]: r for r in rows(neighbours.near_vectors(spark.createDataFrame(given, "vec_id bigint, embedding array<double>")))}
    assert {i: r["component_id"] for i, r in out.items()} == {0: 0, 1: 0, 4: 0, 2: 2, 3: 3} and out[0]["n_links"] == 2


# --- 6 tokens


def odd_texts(n=1_500):
    rng = random.Random(8)
    bits = ["<|endoftext|>", "it's", "I'LL", "abć", "́", "\xa0", " ", "  ", "\n", "\x1c", "x²", "Ⅷ", "ß", "İ", "don't", "<|startoftext|>", "中文", "🙂", "\t", "123", "..", "'", "_", "½", "é", "é", "Ａ", "the", "Table"]
    return ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("huge", [tokens.HUGE_CHARS, 20])
def test_token_ids(path, huge):
    encode, library = tokens.Encoder(path, huge, 12, 3), Tokenizer.from_file(path)
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode.ids(text), "<u4").tolist() == want, text


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("chars", [tokens.CUT_CHARS, 9])
def test_texts_encoded_together(path, chars, monkeypatch):
    monkeypatch.setattr(tokens, "CUT_CHARS", chars)
    monkeypatch.setattr(tokens, "MEMO", 50)
    texts = ["", "word", *odd_texts(400), "a" * 40 + " " + "a" * 40, *(" ".join(x) for x in zip(odd_texts(300), reversed(odd_texts(300))))]
    encode, library = tokens.Encoder(path), Tokenizer.from_file(path)
    got = [part.tolist() for at, ids, ends in encode.encoded(texts) for part in np.split(ids, ends[:-1])]
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert got == want
    assert encode.counts(texts).tolist() == [len(ids) for ids in want]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_white_space_around_added_tokens(path, monkeypatch):
    """Every pair of a run of white space and an added token, one text at a time and together, short and in chunks."""
    library = Tokenizer.from_file(path)
    runs = ["", " ", "  ", "\n", "\n\n", "\r\n\n", "\t ", " \n", "\n ", "\n \n", "\xa0\n", "   "]
    added = [t.content for t in library.get_added_tokens_decoder().values()] + ["<|other|>", "<"]
    texts = [f"{head}{a}{token}{b}{tail}" for a in runs for b in runs for token in added for head, tail in (("", ""), ("a", "x"), ("1.", "\n"))]
    texts += ["a" * 30 + t + " b c" * 9 for t in texts[::7]]
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [library.encode(t, add_special_tokens=False).ids for t in texts] == want
    for encode in (tokens.Encoder(path), tokens.Encoder(path, 16, 12, 3)):
        assert [part.tolist() for _, ids, ends in encode.encoded(texts) for part in np.split(ids, ends[:-1])] == want
        for text, ids in zip(texts, want, strict=True):
            assert np.frombuffer(encode.ids(text), "<u4").tolist() == ids, text


def test_token_counts(odd_docs, no_docs):
    library = Tokenizer.from_file(BYTE)
    out = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows(tokens.count_tokens(odd_docs, BYTE)))
    want = []
    for i, t in pairs(odd_docs):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i or -1, len((t or "").encode()), n, n > 512))
    assert out == sorted(want) and tokens.count_tokens(no_docs, BYTE).count() == 0


def test_text_without_a_boundary_is_encoded_whole():
    library, text = Tokenizer.from_file(BYTE), "ab1" * 3_000
    assert tokens.Encoder(BYTE, 100, 64, 8).counts([text]).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]


# --- 7 near duplicates


def classes(docs):
    bags = {}
    for i, t in sorted(docs, key=lambda d: d[1] or ""):
        if i is not None and i not in bags:
            ws = (t or "").lower().split()
            bags[i] = Counter(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else Counter()
    links, ids = [], sorted(bags)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = bags[i], bags[j]
            both = sum((a & b).values())
            if (not a and not b) or (both and both >= 0.8 * (sum(a.values()) + sum(b.values()) - both)):
                links.append((i, j))
    return tops(links, ids)


def test_near_duplicates(spark, corpus):
    rng = random.Random(12)
    ws = [f"w{k}" for k in range(150)]
    group = []
    for k in range(60):  # copies of one text of which many are near to some other copy only
        copy = list(ws)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(150)] = f"x{rng.randrange(40)}"
        group.append((500 + k, " ".join(copy), "en", "g", 1))
    docs = corpus.unionByName(spark.createDataFrame(group, corpus.schema))
    out = {r["doc_id"]: r["class_id"] for r in rows(near_dups.near_duplicates(docs))}
    assert out == classes(pairs(docs))
    kept = near_dups.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == sorted(set(out.values()))


def test_an_id_with_two_texts_is_judged_by_the_first(spark):
    texts = [" ".join(f"{x}{k}" for k in range(60)) for x in "ab"]
    docs = spark.createDataFrame([(4, texts[1]), (4, texts[0]), (9, texts[1]), (11, texts[0])], "doc_id bigint, text string").repartition(4)
    assert {r["doc_id"]: r["class_id"] for r in rows(near_dups.near_duplicates(docs))} == {4: 4, 9: 9, 11: 4}


def test_near_duplicates_odd(odd_docs, no_docs):
    out = {r["doc_id"]: r["class_id"] for r in rows(near_dups.near_duplicates(odd_docs))}
    assert out == classes(pairs(odd_docs))
    assert near_dups.near_duplicates(no_docs).count() == 0


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(12):
        e = rng.integers(0, 2**63, 150).astype(np.uint64)
        a, b = rng.integers(1, 9, 150), rng.integers(1, 9, 150)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        errors.append((near_dups.bag_minhash(e, a, 1_000) == near_dups.bag_minhash(e, b, 1_000)).mean() - want)
    assert abs(np.mean(errors)) < 0.012


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)]
    out = {r["id"]: r["component"] for r in rows(components.components(spark.createDataFrame(links, "a bigint, b bigint")))}
    want = tops(links, {i for link in links for i in link})
    assert out == {i: c for i, c in want.items() if any(i in link and link[0] != link[1] for link in links)}


# --- 8 fingerprints


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances():
    rng = random.Random(1)
    a, b = (["".join(rng.choices("ABC", k=rng.choice([0, 1, 9, 63, 64]))) for _ in range(200)] for _ in "ab")
    assert fingerprints._edit_distances(a, b).tolist() == [distance(x, y) for x, y in zip(a, b)]


def slow_fingerprint(text):
    """Byte by byte: the last eight bytes as a little-endian number, mixed, end a chunk where its top bits are zero; a chunk's character
    is that of the sum of its windows' numbers, and what is left after the last character's chunk begins goes into it."""
    data, mask, window, hashes = text.encode(), 2**64 - 1, 0, []
    if not data:
        return "0::"
    for byte in data:
        window = (window >> 8) | (byte << 56)
        h = window * 0x9E3779B97F4A7C15 & mask
        hashes.append((h ^ (h >> 29)) * 0xD6E8FEB86659FD93 & mask)

    def chunks(bits):
        out, total, n = [], None, 0
        for h in hashes:
            total = (total or 0) + h & mask
            n += 1
            if h >> (64 - bits) == 0 and len(out) < fingerprints.LENGTH - 1:
                out.append(total)
                total, n = None, 0
        return out + ([total] if n else [])

    def signature(bits):
        return "".join(fingerprints.ALPHABET[(t * 0x9E3779B97F4A7C15 & mask) >> 58] for t in chunks(bits))

    k = max(1, math.ceil(math.log2(len(data) / fingerprints.LENGTH)) + 1)
    while k > 1 and sum(h >> (64 - k) == 0 for h in hashes) < fingerprints.LENGTH // 2:
        k -= 1
    return f"{k}:{signature(k)}:{signature(k + 1)}"


def test_signatures_byte_by_byte():
    rng = random.Random(12)
    texts = ["a", "ab" * 400, "é" * 77, "\0" * 300, " ".join(str(rng.random()) for _ in range(900))]
    texts += ["".join(rng.choices("abc dé中🙂", k=rng.randint(1, 4_000))) for _ in range(60)]
    for t in texts:
        assert fingerprints.fingerprint(t) == slow_fingerprint(t), t[:50]
    assert len({fingerprints.fingerprint(t) for t in texts}) == len(texts)


def test_fingerprints(corpus, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "PART_ROWS", 13)
    for docs in (corpus, odd_docs):
        ordered = sorted(pairs(docs), key=lambda d: (d[0] is None, d[0] or 0, d[1] or ""))
        want = []
        for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
            t, edited = t or "", fingerprints.edited_text(t or "", after or "")
            prints = [fingerprints.fingerprint(x) for x in (t, edited, after or "")]
            want.append((i or -1, len(t), hashlib.sha256(edited.encode()).hexdigest(), *prints[:2], *(round(float(fingerprints.likeness([prints[0]], [p])[0]), 9) for p in prints[1:])))
        got = [(r[0] or -1, *r[1:5], round(r[5], 9), round(r[6], 9)) for r in fingerprints.compared_with_edits(docs).collect()]
        assert sorted(got) == sorted(want)
    near = fingerprints.compared_with_edits(corpus).where("n_chars > 200")
    assert near.where("near_edited <= near_next").count() <= 12  # copies follow copies
    assert fingerprints.compared_with_edits(no_docs).count() == 0


# --- 9 mixing


def goals(sizes):
    weights = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(v for s, v in weights.items() if s not in capped)
        share = {s: 3.0 * sizes[s] if s in capped else left * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in capped and share[s] > 3 * sizes[s]}
        if not over:
            return share
        capped |= over


def test_mixing(corpus, odd_docs, no_docs):
    for docs in (corpus, odd_docs):
        out = rows(mixing.mix(docs, bin_rows=7))
        by = defaultdict(list)
        for r in out:
            by[r["source"]].append(r)
        sizes = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
        want = goals(sizes)
        for s, rs in by.items():
            assert all(r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) for r in rs)
            assert sum(r["taken"] for r in rs) == math.floor(rs[0]["target"])
            assert all(0 <= r["taken"] <= 3 * r["size"] for r in rs)
        again = sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in rows(mixing.mix(docs)))
        assert again == sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in out)
        mixed = mixing.mixed_documents(docs)
        assert mixed.columns == docs.columns
        assert mixed.selectExpr(r"sum(regexp_count(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))").first()[0] == sum(r["taken"] for r in out)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


# --- 10 packing


def test_packing(corpus, odd_docs, no_docs):
    library = Tokenizer.from_file(WORD)
    for docs, options in ((corpus, {"group_rows": 30}), (odd_docs, {})):
        out = rows(packing.pack_documents(docs, WORD, capacity=256, **options))
        want = Counter()
        for i, t in pairs(docs):
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
            for k in range(0, len(ids), 256):
                part = np.array(ids[k : k + 256], "<u4")
                want[(i, k // 256, k, len(part), zlib.crc32(part.tobytes()))] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
        bins = defaultdict(list)
        for r in out:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 256
        lengths, counts = np.unique([r["length"] for r in out], return_counts=True)
        assert packing.lower_bound(lengths, counts, 256) <= len(bins) <= 1.02 * packing.lower_bound(lengths, counts, 256) + 1
    assert packing.pack_documents(no_docs, WORD).count() == 0


def test_lower_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(4)
    for _ in range(200):
        sizes = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets = packing.best_fit_decreasing(sizes, 100)
        fill = np.bincount(bins, sizes)
        assert fill.max() <= 100 and packing.lower_bound(*np.unique(sizes, return_counts=True), 100) <= len(fill)
    assert packing.lower_bound(np.array([51]), np.array([7]), 100) == 7
