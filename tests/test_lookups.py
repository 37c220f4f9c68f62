"""Kept answers: keys as the service's client writes them, and collections followed through them."""

import json

from pyspark.sql import functions as F

from shelfwise.operators import lookups


def key(path, **params):
    return f"{path}?{json.dumps({'language': 'en-US'} | params, sort_keys=True)}"


def test_keys_are_canonical(spark):
    texts = ["Amélie", 'a "b" \\ c', "tab\there\n", "", "日本 🙂", "plain", "\x01"]
    df = spark.createDataFrame([(t, 1990 + k if k % 2 else None) for k, t in enumerate(texts)], "q string, y int")
    got = df.select(lookups.request_key(F.lit("/search/movie"), {"query": F.col("q"), "api_key": F.lit("secret")}, {"primary_release_year": F.col("y")}).alias("k")).collect()
    want = [key("/search/movie", query=t, **({"primary_release_year": 1990 + k} if k % 2 else {})) for k, t in enumerate(texts)]
    assert [r.k for r in got] == want


def test_refusals_are_kept_and_errors_are_not(spark):
    rows = [("a", 200, '{"x": 1}', 1), ("a", 200, '{"x": 2}', 2), ("b", 404, "gone", 1), ("c", 500, "oops", 1), ("d", 401, "", 1), ("a", 500, "later", 3), ("e", 200, "{broken", 1)]
    cache = lookups.kept(spark.createDataFrame(rows, "key string, status int, body string, asked int"))
    assert {r.key: r.body for r in cache.collect()} == {"a": '{"x": 2}', "b": '{"__status__": 404}', "d": '{"__status__": 401}', "e": "{broken"}
    got = lookups.asked(spark.createDataFrame([(k,) for k in "abcdef"], "key string"), cache, "x int")
    got = {r.key: (r.known, r.answer and r.answer.x) for r in got.collect()}
    assert got == {"a": (True, 2), "b": (True, None), "c": (False, None), "d": (True, None), "e": (True, None), "f": (False, None)}


def test_collections_are_opened_by_series_only(spark):
    answers = {}

    def film(imdb, id_, collection=None, parts=None, name="C"):
        answers[key(f"/find/{imdb}", external_source="imdb_id")] = {"movie_results": [{"id": id_}, {"id": 999}] if id_ else []}
        answers[key(f"/movie/{id_}")] = {"belongs_to_collection": collection and {"id": collection, "name": f"{name}{collection}"}}
        answers[key(f"/movie/{id_}/external_ids")] = {"imdb_id": imdb.upper()}

    for n in range(1, 9):
        film(f"tt{n}", n, {1: 10, 2: 10, 3: 10, 4: 20, 5: 20, 6: 30}.get(n))
    film("tt100", None)
    part = lambda n, date="2000-01-01": {"id": n, "title": f"T{n}" if n % 2 else "", "original_title": f"O{n}", "release_date": date}
    answers[key("/collection/10")] = {"parts": [part(1), part(2), part(3), part(7), part(8, ""), part(9, "2999-01-01")]}
    answers[key("/collection/20")] = {"parts": [part(4), part(5)]}
    answers[key("/collection/30")] = {"parts": [part(6), part(11)]}
    del answers[key("/movie/8/external_ids")]
    answers[key("/movie/7")] = {"belongs_to_collection": {"id": 40, "name": "never opened"}}
    cache = spark.createDataFrame([(k, json.dumps(v)) for k, v in answers.items()] + [(key("/find/tt404", external_source="imdb_id"), '{"__status__": 404}')], "key string, body string")
    series = spark.createDataFrame([("S1", "tt1"), ("S2", "TT1"), ("S1", "tt100"), ("S2", "tt404"), ("S3", "tt4"), ("S3", "tt777"), ("S3", None)], "folder string, imdb string")
    alone = spark.createDataFrame([("tt2",), ("tt6",), ("tt5",), (None,)], "imdb string")  # tt6 is of a collection that no series opens
    missing, to_fetch = lookups.collections(series, alone, cache, "2024-01-01")
    assert sorted(map(tuple, missing.collect())) == [(10, "C10", "S1 | S2", 3, "T3", "tt3", "2000-01-01"), (10, "C10", "S1 | S2", 7, "T7", "tt7", "2000-01-01")]
    assert {r.key for r in to_fetch.collect()} == {key("/find/tt777", external_source="imdb_id"), key("/movie/8/external_ids"), key("/movie/9/external_ids")}
    more, _ = lookups.collections(series, alone, cache, "2024-01-01", unreleased=True)
    assert {r.film_id for r in more.collect()} == {3, 7, 8, 9}
    empty, ask = lookups.collections(series.limit(0), alone, cache.limit(0), "2024-01-01")
    assert empty.count() == 0 and ask.count() == 0
