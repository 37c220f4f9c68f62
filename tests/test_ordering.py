"""Places, names that meet and rollbacks against what doing it step by step gives."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import collisions, ordering


def test_running_sums_of_any_group_size(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "hot", "hot", "hot"]), k, rng.randint(-3, 9)) for k in range(700)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(5)
    got = {r.k: (r.place, r.total) for r in ordering.running(ordering.running(df, [F.col("k")], ("g",)), [F.col("k")], ("g",), F.col("v"), "total").collect()}
    seen = {}
    for g, k, v in rows:
        n, total = seen.get(g, (0, 0))
        seen[g] = n + 1, total + v
        assert got[k] == seen[g]
    everything = {r.k: r.place for r in ordering.running(df, [F.desc("v"), F.col("k")]).collect()}
    assert [everything[k] for _, k, _ in sorted(rows, key=lambda r: (-r[2], r[1]))] == list(range(1, 701))
    names = {(r.g, r.v): r.number for r in ordering.dense(df, ["g", "v"]).collect()}
    assert [names[k] for k in sorted(names, key=lambda e: (e[0] is not None, e[0] or "", e[1]))] == list(range(1, len(names) + 1))
    assert ordering.running(df.limit(0), [F.col("k")]).count() == 0


def one_after_the_other(wants, taken):
    """The rule itself: each file takes its name, or the first numbered one that nobody has."""
    seen = {f: {n.lower() for g, n in taken if g == f} for f in {w[0] for w in wants}}
    out = {}
    for folder, place, name in sorted(wants, key=lambda w: w[1]):
        if name is None:
            out[folder, place] = None
            continue
        final, i = name, 2
        if name.lower() in seen[folder]:
            base, dot, ext = name.rpartition(".")
            base, rest = (base, dot + ext) if base else (name, "")
            while f"{base}.{i}{rest}".lower() in seen[folder]:
                i += 1
            final = f"{base}.{i}{rest}"
        seen[folder].add(final.lower())
        out[folder, place] = final
    return out


@pytest.mark.parametrize("seed", range(6))
def test_names_as_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    names = ["x.srt", "X.srt", "x.2.srt", "x.3.srt", "x.4.srt", "x.2.2.srt", "x.2.3.srt", "x.02.srt", "x.1.srt", "x", "x.2", "x.12.srt", "x.2.2.2.srt", ".srt", "y.en.srt", "y.en.2.srt", None]
    pool = rng.choices(names, k=rng.randint(3, 9))
    wants = [(f"f{rng.randrange(3)}", k, rng.choice(pool)) for k in rng.sample(range(400), 140)]
    taken = [(f"f{k}", n) for k in range(3) for n in rng.sample(names[:-1], 2)] if seed % 2 else []
    df = spark.createDataFrame(wants, "folder string, place int, name string").repartition(3)
    got = collisions.distinct_names(df, spark.createDataFrame(taken, "folder string, name string") if taken else None).collect()
    assert {(r.folder, r.place): r.final for r in got} == one_after_the_other(wants, taken)
    assert len(got) == len(wants)


def test_a_name_that_most_files_want(spark):
    wants = [("f", k, "same.srt") for k in range(300)] + [("f", 1000 + k, f"same.{k}.srt") for k in range(2, 500, 7)] + [("f", 150.5 * 2 + k, "same.900.srt") for k in range(2)]
    wants = [(f, int(p * 2), n) for f, p, n in wants]
    got = collisions.distinct_names(spark.createDataFrame(wants, "folder string, place int, name string").repartition(4))
    found = {(r.folder, r.place): r.final for r in got.collect()}
    assert found == one_after_the_other(wants, []) and len({v.lower() for v in found.values()}) == len(wants)
    assert collisions.distinct_names(spark.createDataFrame([], "folder string, place int, name string")).count() == 0


def test_recovered_and_merged_names(spark):
    there = ["a/x.avi", "a/x.recovered.avi", "a/x.recovered3.avi", "b/y", "b.c/z", "b/.hidden"]
    back = ["a/x.avi", "a/x.avi", "a/x.avi", "a/new.avi", "a/new.avi", "b/y", "b/y", "b.c/z", "b/.hidden"] + ["a/many.avi"] * 53
    got = collisions.recovered_names(spark.createDataFrame(list(enumerate(back)), "place int, path string").repartition(2), spark.createDataFrame([(p,) for p in there], "path string"))
    want, seen = {}, set(there)
    for k, path in enumerate(back):
        folder, _, name = path.rpartition("/")
        stem, dot, ext = name.rpartition(".") if not re.fullmatch(r"\.?[^.]+", name) else (name, "", "")
        final, n = path, 1
        while final in seen:
            final = f"{folder}/{stem}.recovered{n if n > 1 else ''}{dot}{ext}"
            n += 1
        want[k] = final if n <= 50 else None
        seen.add(final)
    assert {r.place: r.final for r in got.collect()} == want
    merged = collisions.merged_names(spark.createDataFrame([("s", "e1"), ("s", "e2")], "folder string, name string"), spark.createDataFrame([("s", "e2"), ("t", "e1")], "folder string, name string"))
    assert sorted(map(tuple, merged.collect())) == [("s", "e1", "e1"), ("s", "e2", "_dup_e2")]


class Disk:
    """Files and folders, and a journal of what is done to them."""

    def __init__(self, files):
        self.files, self.lines = dict(files), []
        self.folders = {f.rsplit("/", k)[0] for f in files for k in range(1, f.count("/") + 1)}

    def parents(self, path):
        return [path.rsplit("/", k)[0] for k in range(path.count("/"), 0, -1)]

    def log(self, op, from_=None, to=None, result="ok"):
        self.lines.append((len(self.lines), len(self.lines) // 3, op, result, from_, to))

    def mkdir(self, path):
        for folder in [*self.parents(path), path]:
            if folder not in self.folders:
                self.folders.add(folder)
                self.log("mkdir", to=folder)

    def move(self, a, b, op):
        self.mkdir(b.rpartition("/")[0])
        self.files[b] = self.files[a] if op == "copy" else self.files.pop(a)
        self.log(op, a, b)
        if op == "copy":
            del self.files[a]
            self.log("delete", a)

    def rmdir(self, path):
        if not any(f.startswith(path + "/") for f in [*self.files, *self.folders]):
            self.folders.discard(path)
            self.log("rmdir", path)

    def undo(self, inverse, source, target):
        if inverse in ("move_back", "restore_and_delete", "restore"):
            assert source in self.files and (target not in self.files or inverse == "restore")
            self.files[target] = self.files.pop(source)
        elif inverse == "delete":
            del self.files[source]
        elif inverse == "mkdir":
            assert target.rpartition("/")[0] in self.folders or "/" not in target
            self.folders.add(target)
        elif inverse == "rmdir_if_empty" and not any(f.startswith(source + "/") for f in [*self.files, *self.folders]):
            self.folders.discard(source)


@pytest.mark.parametrize("seed", range(4))
def test_rollback_steps_undo_a_run(spark, seed):
    from shelfwise.plans import journal

    rng = random.Random(seed)
    files = {f"old/{rng.choice('abc')}/{rng.choice('xy')}/f{k}": k for k in range(14)}
    disk = Disk(files)
    folders = set(disk.folders)
    for k in range(60):
        a = rng.choice(sorted(disk.files))
        what = rng.random()
        if what < 0.5:
            disk.move(a, f"new/{rng.choice('pq')}/{rng.choice('rs')}/m{k}", rng.choice(["rename", "move", "copy", "dup_move"]))
        elif what < 0.65:
            disk.move(a, f"{a}.bak{k}", "backup")
            disk.files[a] = -k
            disk.log("write_file", to=a)
        elif what < 0.9:
            disk.rmdir(rng.choice(sorted(disk.folders)))
        else:
            disk.log(rng.choice(["rename", "verify", "run_start"]), "none", "nowhere", rng.choice(["error", "dry-run"]))
    df = spark.createDataFrame(disk.lines, "line int, t int, op string, result string, from_ string, to string").withColumn("ts", F.timestamp_seconds("t")).repartition(4)
    steps = journal.rollback_steps(df).orderBy("place").collect()
    assert [r.place for r in steps] == list(range(1, len(steps) + 1))
    for r in steps:
        disk.undo(r.inverse, r.source, r.target)
    assert disk.files == files and disk.folders == folders


def test_selected_lines(spark):
    from shelfwise.plans import journal

    rows = [(0, "2024-01-01T00:00:00Z", "r1", 1), (1, "2024-01-02T00:00:00Z", "r2", 1), (2, "2024-01-02T00:00:05Z", "r2", 2), (3, "2024-01-03T00:00:00Z", "r1", 2), (4, None, "r3", None), (5, "2024-01-04T00:00:00Z", "r3", 3), (6, "2024-01-05T00:00:00Z", "r2", 1)]
    df = spark.createDataFrame(rows, "line int, t string, run_id string, title_id int").withColumn("ts", F.to_timestamp("t"))
    lines = lambda d: sorted(r.line for r in d.collect())
    assert lines(journal.selected(df, run="r2")) == [1, 2, 6]
    assert lines(journal.selected(df, title=1)) == [1, 6] and lines(journal.selected(df, title=2)) == [3]
    assert lines(journal.selected(df, since="2024-01-03T00:00:00Z")) == [3, 5, 6]
    assert lines(journal.latest_runs(df)) == [1, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        journal.selected(df, run="r1", title=1)
