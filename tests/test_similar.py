"""Near duplicates and dictionary repairs against comparisons of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from grainsift.functions import edits
from grainsift.operators import similar


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (x != y))
    return row[-1]


def words(n, seed, letters="abcé", longest=9):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("d", [0, 1, 2, 3])
def test_pairs_within_a_distance_share_a_key(spark, d):
    texts = sorted({*words(60, d), *words(40, d + 9, "ab", 14)})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    rows = {r.t: r for r in df.select("t", edits.substring_keys(t, d).alias("found"),
                                      F.when(F.char_length(t) > d, edits.segment_keys(t, d)).alias("cut"),
                                      edits.deletion_keys(t, d).alias("gone")).collect()}
    for a in texts:
        for b in texts:
            if distance(a, b) <= d:
                assert {*rows[a].gone} & {*rows[b].gone}
                if d < len(a) <= len(b):
                    assert {*rows[a].cut} & {*rows[b].found}


@pytest.mark.parametrize("d,block", [(0, 2000), (1, 2), (2, 3), (2, 2000), (3, 5)])
def test_near_duplicates_equal_all_pairs(spark, d, block):
    rng = random.Random(d)
    rows = [(k, t, rng.choice(["x", "y", None])) for k, t in enumerate(words(70, d + 1, longest=8) + words(30, 77, "ab", 12))]
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(0, 60, 7)] + [(300, None, "x"), (None, "abc", "x"), (301, "", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k int, name string, part string, __n int").drop("__n").repartition(4)
    for within in ([], ["part"]):
        links = lambda r: [s for s in rows if r[0] is not None and s[0] is not None and r[1] is not None and s[1] is not None
                           and s[0] != r[0] and distance(r[1], s[1]) <= d and (not within or r[2] == s[2])]
        wanted = sorted(((*r, len(links(r)), min([r[0], *(s[0] for s in links(r))], key=lambda k: (k is None, k))) for r in rows), key=repr)
        got = similar.near_duplicates(df, "name", "k", d, within, block_rows=block)
        assert sorted(map(tuple, got.collect()), key=repr) == wanted
    kept = similar.remove_near_duplicates(df, "name", "k", d, ["part"], block_rows=block)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted((r[:3] for r in wanted if r[0] == r[4]), key=repr)


def test_pairs_list_texts_once(spark):
    rows = [(5, "anna"), (3, "anna"), (9, "annA"), (7, "Anna "), (1, None)]
    df = spark.createDataFrame(rows, "k int, name string")
    pairs = sorted(map(tuple, similar.near_pairs(df, "name", "k", 1).collect()))
    assert pairs == [(9, "annA", 1, 3, "anna", 2, 1)]
    assert similar.near_pairs(df, "name", "k", 1, fold=True).count() == 0  # all of them are one text
    assert [r.n_links for r in similar.near_duplicates(df, "name", "k", 0, fold=True).orderBy("k").collect()] == [0, 3, 3, 3, 3]
    assert similar.near_duplicates(df.limit(0), "name", "k").count() == 0


def test_refusals(spark):
    df = spark.createDataFrame([(1, "a", 2)], "k int, name string, n_links int")
    with pytest.raises(ValueError, match="no text"):
        similar.near_pairs(df, "k", "k")
    with pytest.raises(ValueError, match="already"):
        similar.near_duplicates(df, "name", "k")
    with pytest.raises(ValueError, match="negative"):
        similar.near_pairs(df, "name", "k", -1)
    with pytest.raises(ValueError, match="ties"):
        similar.snap_to_dictionary(df, "name", ["a"], ties="first")


@pytest.mark.parametrize("d", [0, 1, 2])
@pytest.mark.parametrize("ties", ["least", "none"])
def test_nearest_values_equal_all_pairs(spark, d, ties):
    allowed = sorted({*words(25, 5), "a" * 40, "a" * 39 + "b", "long " * 10})
    values = sorted({*words(80, 6), "a" * 38, "b" + "a" * 39, "long " * 10 + "x", "Long " * 9 + "long "})
    wanted = {}
    for v in values:
        near = sorted((distance(v, a), a) for a in allowed if distance(v, a) <= d)
        if v not in allowed and near and (ties == "least" or [n for n, _ in near].count(near[0][0]) == 1):
            wanted[v] = near[0]
    found = similar.nearest_values(spark.createDataFrame([(v,) for v in [*values, None, values[0]]], "x string"),
                                   spark.createDataFrame([(a,) for a in [*allowed, None]], "y string"), d, ties=ties)
    assert {r.value: (r.distance, r.nearest) for r in found.collect()} == wanted
    assert found.count() == len(wanted)


def test_snap_keeps_rows_and_other_columns(spark):
    rows = [(1, "BUILDIN", "x"), (2, "building ", None), (3, None, "z"), (4, "TRUCK", "q"), (5, "BUILDING", ""), (6, "BUILDIN", "x")]
    df = spark.createDataFrame(rows, "value int, seg string, nearest string")
    fixed = similar.snap_to_dictionary(df, "seg", ["BUILDING", "MACHINERY"], 1, fold=True)
    assert fixed.columns == df.columns
    assert sorted(map(tuple, fixed.collect())) == [
        (1, "BUILDING", "x"), (2, "BUILDING", None), (3, None, "z"), (4, "TRUCK", "q"), (5, "BUILDING", ""), (6, "BUILDING", "x")]
    odd = similar.snap_to_dictionary(df.withColumnRenamed("value", "v").withColumnRenamed("seg", "value"), "value", ["BUILDING"], 1)
    assert [r.value for r in odd.orderBy("v").collect()] == ["BUILDING", "building ", None, "TRUCK", "BUILDING", "BUILDING"]
    assert sorted(map(tuple, similar.snap_to_dictionary(df, "seg", df.limit(0).select("seg"), 1).collect()), key=repr) == sorted(rows, key=repr)


def numbered(spark, n):
    rows = [(i, f"Customer#{i:09d}") for i in range(n)] + [(n + i, f"customer#{i:09d}") for i in range(0, n, 40)]
    return rows, spark.createDataFrame(rows, "k int, name string")


def test_texts_behind_one_prefix_are_counted_whole(spark):
    rows, df = numbered(spark, 1200)
    got = {r.k: (r.n_links, r.first_key) for r in similar.near_duplicates(df, "name", "k", 2).collect()}
    assert len(got) == len(rows)
    for k, name in (rows[0], rows[1010], rows[1199], rows[-2]):
        near = [j for j, other in rows if j != k and distance(name, other) <= 2]
        assert got[k] == (len(near), min([k, *near]))


def test_rows_made_from_texts_are_never_broadcast(spark):
    _, df = numbered(spark, 300)
    for d in (1, 2, 3):
        plan = similar.near_pairs(df, "name", "k", d)._jdf.queryExecution().sparkPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line and "levenshtein" in line]
        assert joins and not [line for line in joins if "Broadcast" in line]


def test_a_segment_shared_by_many_texts_joins_none_of_them(spark):
    rows, df = numbered(spark, 300)
    nodes = similar.materialized(similar._nodes(df, "name", "k", [], False), "texts")
    met, dense = similar._compared(nodes, 1, 0, similar.BLOCK_ROWS)
    assert dense.count() == 300 and met.count() < 100  # the few in lower case are compared, no others
    pairs = similar.near_pairs(df, "name", "k", 1).collect()
    wanted = sum(distance(a, b) <= 1 for _, a in rows[:40] for _, b in rows[:40] if a < b)
    assert sum(p.key_a < 40 and p.key_b < 40 for p in pairs) == wanted and all(p.text_a < p.text_b for p in pairs)


@pytest.mark.parametrize("d", [1, 2])
def test_texts_of_different_lengths_behind_one_segment_are_not_compared_all(spark, monkeypatch, d):
    rows = [(i, f"Customer#{i // 4:06d}_{(0, 1, 10, 100)[i % 4]}") for i in range(1200)]
    rows += [(2000 + i, "y" * 28 + f"{i // 3:03d}" + "x" * (i % 3)) for i in range(750)]  # 31 to 33 characters
    df, met, join = spark.createDataFrame(rows, "k int, name string"), [], similar._met

    def counted(index, probe, *more):
        longer = probe.select("__k", F.char_length("__t").alias("__len"))
        met.append(index.join(longer, "__k").filter((F.char_length("__t") < F.col("__len")) & (F.char_length("__t") <= 32)).count())
        return join(index, probe, *more)

    monkeypatch.setattr(similar, "_met", counted)
    got = sorted((min(r.key_a, r.key_b), max(r.key_a, r.key_b), r.distance) for r in similar.near_pairs(df, "name", "k", d).collect())
    other, n = df.toDF("k2", "name2"), F.levenshtein("name", "name2")
    assert got == sorted(map(tuple, df.join(other, (F.col("k") < F.col("k2")) & (n <= d)).select("k", "k2", n).collect()))
    assert sum(len(dict(rows)[a]) != len(dict(rows)[b]) for a, b, _ in got) > 900
    assert sum(met) < 50 * len(rows)
