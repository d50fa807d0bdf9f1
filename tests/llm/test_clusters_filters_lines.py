"""Centroid clusters, filter audits and line removal against plain versions, on odd rows too."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from grainsift.llm import clustering, filteraudit, linededup


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- clusters ----------------------------------------------------------------


def plain_clusters(rows, k=16, rounds=3, dims=64):
    kept = [(i, tuple(math.floor(64 * Fraction(x)) for x in e)) for i, e in rows
            if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), e) for i, e in kept if i is not None)
    centroids = [e for _, e in start[:k]]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))

    def assign():
        return [min((far(e, c), n) for n, c in enumerate(centroids)) for _, e in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            own = [e for (_, e), (_, c) in zip(kept, found) if c == n]
            if own:
                centroids[n] = tuple(sum(column) // len(own) for column in zip(*own))
    found = assign()
    inertia = defaultdict(int)
    for d, c in found:
        inertia[c] += d
    fits = lambda x: x if x < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    broken = {c for d, c in found if d >= 1 << 63}
    return sorted(((i, c, fits(d), None if c in broken else fits(inertia[c]), None if broken else fits(sum(inertia.values())), sha[c])
                   for (i, _), (d, c) in zip(kept, found)), key=repr)


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, cluster int, distance string")


def some_vectors(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dims))
    rows = [(k, (centres[k % 20] + rng.normal(size=dims) * 0.3).tolist()) for k in range(n)]
    rows += [(n + k, rows[5][1]) for k in range(n // 2)]  # a third are copies of one vector
    return rows


def test_clusters(spark):
    rows = some_vectors(240, 64)
    rows += [(900, None), (901, []), (902, rows[0][1][:-1]), (903, [None, *rows[0][1][1:]]), (904, [math.nan] * 64),
             (905, [math.inf, *rows[0][1][1:]]), (None, rows[7][1]), (8, rows[8][1]), (8, rows[9][1]), (906, [0.0] * 64),
             (907, [-1e-300] * 64)]
    got = clustering.cluster(vector_table(spark, rows).repartition(5))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert rows_of(got) == plain_clusters(rows)


def test_huge_components_ties_and_few_vectors(spark):
    huge = [(k, [(-1) ** k * x, 1.0, 0.5]) for k, x in enumerate([1e4, 3e7, 1e18, 1e200, 1.7e308, 2.0, 0.015625])]
    assert rows_of(clustering.cluster(vector_table(spark, huge), k=3, dims=3)) == plain_clusters(huge, k=3, dims=3)
    few = [(k, [float(k), 0.0]) for k in range(3)]
    assert rows_of(clustering.cluster(vector_table(spark, few), dims=2)) == plain_clusters(few, dims=2)
    square = [(k, [float(x), float(y)]) for k, (x, y) in enumerate(itertools.product(range(-3, 4), repeat=2))]
    assert rows_of(clustering.cluster(vector_table(spark, square), k=4, dims=2)) == plain_clusters(square, k=4, dims=2)


def test_no_clusters(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        got = clustering.cluster(vector_table(spark, rows))
        assert got.count() == 0 and [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    nameless = clustering.cluster(vector_table(spark, [(None, [0.0] * 64)])).collect()
    assert [(r.vec_id, r.cluster, r.distance) for r in nameless] == [(None, None, None)]
    with pytest.raises(ValueError, match="power of two"):
        clustering.cluster(vector_table(spark, []), scale=10)


@pytest.mark.parametrize("spread", [0.01, 0.3, 3.0])
def test_bounds_never_exceed_distances_and_save_checks(spread):
    rng = np.random.default_rng(1)
    points = rng.integers(-200, 200, size=(16, 64))
    x = points[rng.integers(0, 16, 2000)] + np.floor(rng.normal(size=(2000, 64)) * spread * 50).astype(np.int64)
    model = clustering.Centroids(points, points[:6])
    near = clustering.roots(clustering.squares(x[:, None, :], model.pivots[None]))
    exact = clustering.squares(x[:, None, :], points[None])
    bounds = model.lower_bounds(near)
    assert (bounds * bounds * (1 - clustering.SLACK) <= exact).all()
    cluster, distance, checks = model.assign(x, near)
    assert (distance == exact.min(1)).all() and (cluster == exact.argmin(1)).all()
    assert checks < exact.size if spread < 1 else checks <= 2 * exact.size


# --- filters -----------------------------------------------------------------


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, _, text in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = defaultdict(list)
    for i, source, text in rows:
        text = text or ""
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text),
                 "E": i is not None and least[text] < i}
        parts[source or ""].append((fails, i in good, i in toxic))
    out, shapley = [], Counter()
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = list(docs)
            for step, letter in enumerate(order):
                hit = [d for d in left if d[0][letter]]
                left = [d for d in left if not d[0][letter]]
                shapley[part, letter] += len(hit)
                out.append((part, "".join(order), step + 1, len(left), len(hit), sum(d[0][letter] for d in docs) - len(hit),
                            sum(d[0][letter] and sum(d[0].values()) == 1 for d in docs), sum(d[1] for d in hit),
                            sum(d[2] for d in hit)))
    return sorted(((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out), key=repr)


def test_filter_audit(spark, texts):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None, "", "web|x"]), t) for i, t in texts]
    rows += [(200 + k, "a", "SAME text " * 60) for k in range(40)] + [(300, "b", "A" * 5 + "b" * 95), (301, "b", "A" * 6 + "b" * 94),
             (302, "b", " ".join(f"w{k % 65}" for k in range(100))), (303, "b", " ".join(f"w{k % 64}" for k in range(100))),
             (304, None, "50 % off"), (305, "c", "x y ÄÖ long " + "word " * 20_000), (306, "c", None), (306, "c", "")]
    rng.shuffle(rows)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 310, 2)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id bigint, source string, text string, part string, mask int")
    marks = spark.createDataFrame([(*r, 1) for r in labels], "doc_id bigint, quality int, toxic int, part int")
    got = filteraudit.audit(docs.repartition(4), marks)
    assert got.columns[:3] == ["part", "filter_order", "step"]
    assert rows_of(got) == plain_audit(rows, labels)
    assert filteraudit.audit(docs.limit(0), marks).count() == 0
    assert rows_of(filteraudit.audit(docs, marks.limit(0))) == plain_audit(rows, [])


def test_packed_counters_do_not_overflow():
    packed = filteraudit.Packed("ABC")
    rows = [(mask, bool(mask & 1), False, (1 << 40) - mask) for mask in range(8)] + [(7, False, True, 255)]
    one = {(o, s): rest for o, s, *rest in packed.audit(rows)}
    total = sum(r[3] for r in rows)
    fails = lambda f: sum(n for m, _, _, n in rows if m >> f & 1)
    assert len(one) == 18 and one["ABC", 1][:2] == [total - fails(0), fails(0)]
    assert all(one[o, 3][0] == rows[0][3] for o in ("ABC", "CBA"))  # only the mask 0 is kept by all
    assert sum(one[o, s][1] for o, s in one if o[s - 1] == "B") == one["ABC", 2][-1]


# --- lines -------------------------------------------------------------------


def plain_lines(rows, least=10, min_chars=1):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    seen = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            seen[key(line)].add(("id", i) if i is not None else ("text", text))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(seen[key(x)]) < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(6)
    common = [f"Common line {k}" for k in range(40)]
    rows = [(i, "\n".join(rng.choice([rng.choice(common), f"own {i} {rng.random()}", "", "  "]) for _ in range(rng.randrange(1, 30))))
            for i in range(120)]
    rows += [(1000 + i, f"\tEVERYWHERE \r\nonly here {i}\n everywhere") for i in range(90)]
    rows += [(2000 + i, f"nine\nten{'' if i == 9 else ' '}\nÉté ß\nx") for i in range(10)]
    rows = [(i, t.replace("nine", "other") if i == 2009 else t) for i, t in rows]
    return rows + [(3000, None), (3001, ""), (3002, "\n\n"), (3003, "long " * 20_000 + "\nx"), (3004, "x\n" * 5000),
                   *[(None, f"no id {k}\nnull docs") for k in range(12)], (None, None), (None, "no id 3\nnull docs"),
                   *[(4000, f"one id {k}\nshared by one id") for k in range(12)], rows[3], rows[3]]


@pytest.mark.parametrize("parts", [1, 7, 23])
def test_lines(spark, parts):
    rows = line_rows()
    docs = spark.createDataFrame([(*r, 1, b"k") for r in rows], "doc_id bigint, text string, mark int, keep binary").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(linededup.drop_lines(docs)) == plain_lines(rows)
        if parts == 7:
            assert rows_of(linededup.drop_lines(docs, least=3, min_chars=4)) == plain_lines(rows, 3, 4)
            assert linededup.drop_lines(docs.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("held", [1, 4, 10_000])
def test_streamed_ranges_decide_every_key(held, monkeypatch):
    """Any cut of the sorted rows into ranges and batches gives the lines of frequent keys."""
    monkeypatch.setattr(linededup, "HELD", held)
    rng = random.Random(held)
    for _ in range(60):
        rows = np.array(sorted({(rng.randrange(3), rng.randrange(2), rng.randrange(8), rng.randrange(2), 0, rng.randrange(4), 9)
                                for _ in range(rng.randrange(1, 160))}), np.int64)
        rows = rows[np.lexsort(rows.T[[5, 4, 2, 3, 1, 0]])]
        docs = defaultdict(set)
        for r in rows.tolist():
            docs[tuple(r[:2])].add(tuple(r[2:4]))
        wanted = Counter(tuple(r) for r in rows.tolist() if len(docs[tuple(r[:2])]) >= 5)
        cuts = sorted(rng.sample(range(len(rows) + 1), min(len(rows), 3)))
        goes, open_rows, decided = Counter(), [], defaultdict(set)
        frequent = set()
        for part in np.split(rows, cuts):
            stream = linededup.Stream(5)
            while len(part):
                n = rng.randrange(1, 30)
                stream.add(part[:n])
                part = part[n:]
            stream.end()
            for kind, some in stream.out:
                for r in some.tolist():
                    if kind == linededup.GOES:
                        goes[tuple(r)] += 1
                    else:
                        decided[tuple(r[:2])].add(tuple(r[2:4]))
                        if kind == linededup.OPEN:
                            open_rows.append(tuple(r))
                        else:
                            frequent.add(tuple(r[:2]))
        goes.update(r for r in open_rows if r[:2] in frequent or len(decided[r[:2]]) >= 5)
        assert goes == wanted


def test_bitmaps(spark):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    wanted = {(i, n, d) for i, n, d, _ in plain_lines(rows) if d}
    found = linededup.line_bitmaps(docs).collect()
    assert {(r.doc_id, r.n_lines, r.n_dropped) for r in found} == wanted
    for r in found:
        stays = linededup.unpack(r.n_lines, r.keep)
        assert len(stays) == r.n_lines and (~stays).sum() == r.n_dropped
    assert linededup.unpack(3, linededup.pack(3, np.array([1]))).tolist() == [True, False, True]
