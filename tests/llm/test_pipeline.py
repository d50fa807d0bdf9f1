"""The pipeline's stages on small tables, against plain versions of their decisions."""

import hashlib
import math
import random
import re
import struct

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from grainsift.llm import quality, secretscan
from grainsift.session import new_work_dir

SF = "/root/testdata/sf0.01"
WHITE = r"[^\x20\x09-\x0D]+"


def plain_words(text, pattern=WHITE):
    return re.findall(pattern, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def corpus(spark):
    """A folder with documents (odd ones and clashing columns included), labels and a benchmark; the documents' rows."""
    rng = random.Random(11)
    good = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 3000").orderBy("doc_id").limit(140).collect()
    rows = [(r.doc_id, r.text) for r in good]
    item = " ".join(f"bench{k}" for k in range(14))
    rows += [(5000 + k, " ".join(plain_words(rows[k][1]) + ["more"] * (k % 3))) for k in range(25)]  # near copies
    rows += [(6000, f"It begins here. {item} and it ends."), (6001, f"{item[:40]} no"), (6002, f'a b token = "9f8e7d6c5b4a39281706f5e4d3c2b1a09f8e7d6c" c'),
             (6003, None), (6004, ""), (6005, " \n"), (None, "no id " * 30), (6006, "long words here " * 6000), (6007, rows[2][1]), (6007, rows[2][1])]
    rng.shuffle(rows)
    folder = new_work_dir(spark, "corpus")
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1.0, 2) for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_words int")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, rows[0][1])], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_each_stage_against_a_plain_version(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    kept = P.keep_quality(spark, docs, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(~quality.held_out())
    model = quality.train(docs, labels)
    assert kept.columns == columns
    assert pairs(kept) == sorted(((i, t) for i, t in rows if model.score(t) >= 0.3), key=repr)

    first = P.one_of_each_group(spark, docs, folder)
    sets = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if (w := plain_words(t)) else set() for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k]]
    for a in known:
        for b in known:
            if a < b and (rows[a][0] == rows[b][0] or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])):
                parent[find(b)] = find(a)
    least = {}
    for k in known:
        least[find(k)] = min(rows[k], least.get(find(k), rows[k]))
    others = [r for k, r in enumerate(rows) if k not in set(known)]
    assert first.columns == columns
    assert pairs(first) == sorted([*least.values(), *others], key=repr)

    clean = P.decontaminate_benchmark(spark, docs, folder)
    words = lambda t: plain_words(t, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    item = [f"bench{k}" for k in range(14)]
    windows = {tuple(item[k:k + 10]) for k in range(5)}
    hit = lambda t: any(tuple(w[k:k + 10]) in windows for w in [words(t)] for k in range(len(w) - 9))
    assert clean.columns == columns and any(hit(t) for _, t in rows)
    assert pairs(clean) == sorted(((i, t) for i, t in rows if not hit(t)), key=repr)

    masked = P.mask_secrets(spark, docs, folder)
    forest = secretscan.train(words=secretscan.dictionary(public_tokenizers.path("word_bpe_49k.json")))

    def plain_mask(text):
        for a, b in reversed(secretscan.judged(text, forest)[1]):
            text = text[:a] + "[secret]" + text[b:]
        return text

    assert masked.columns == columns
    assert pairs(masked) == sorted(((i, plain_mask(t)) for i, t in rows), key=repr)
    assert any("[secret]" in (t or "") for _, t in pairs(masked))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in masked.collect())

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    wanted = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        wanted.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                       hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, P.encode(spark, docs, folder).collect()), key=repr) == sorted(wanted, key=repr)


def test_pipeline_of_odd_and_empty_tables(spark, corpus):
    folder, rows = corpus
    assert 0 < P.run(spark, folder).count() < len(rows)
    empty = new_work_dir(spark, "empty")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert P.run(spark, empty).count() == 0


def test_scores_follow_counts_and_weights(spark, corpus):
    """The ratios from counts of rows, margins by plain sums and the curve, against the trained model."""
    folder, rows = corpus
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, labels)
    given = {r.doc_id: r.quality for r in labels.collect()}
    seen = [(set(quality.features(t).tolist()), given[i]) for i, t in rows if given.get(i) is not None]
    counts = [{}, {}]
    for f, y in seen:
        for g in f:
            counts[y][g] = counts[y].get(g, 0) + 1
    total = [sum(c.values()) + (1 << quality.BITS) for c in counts]
    for g in list(counts[1])[:500]:
        ones, zeros = counts[1].get(g, 0) + 1, counts[0].get(g, 0) + 1
        ratio = math.log(ones / total[1]) - math.log(zeros / total[0]) if ones + zeros >= 5 else 0.0
        assert math.isclose(model.ratios[g], ratio, abs_tol=1e-9)
    for r in quality.score(docs, model, "plain_score").filter(F.length("text") < 2000).collect()[:60]:
        f = quality.features(r.text).tolist()
        length = math.sqrt(sum(model.ratios[g] ** 2 for g in f)) or 1.0
        margin = sum(model.weights[g] for g in f) / length + model.bias
        assert math.isclose(r.plain_score, 1 / (1 + math.exp(-max(-30, min(30, model.slope * margin + model.shift)))), rel_tol=1e-6, abs_tol=1e-9)
    with pytest.raises(ValueError, match="there already"):
        quality.score(docs, model, "SCORE")



def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = docs, docs.columns
    kept = {}
    for name, stage in P.STAGES:
        docs = P.stored(stage(spark, docs, SF), "stage")
        kept[name] = docs
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in (before, *kept.values())]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and len(ids[-1]) > 0.6 * len(ids[0])
    assert ids[3] == ids[4] == ids[5]
    secret = re.compile(r'token = "[0-9a-f]{40}"')
    assert any(secret.search(r.text) for r in before.collect())
    assert not any(secret.search(r.text) for r in kept["secret scan"].collect())
    assert all(r.n_chars == len(r.text) for r in kept["secret scan"].collect() if "[secret]" in r.text)
    assert P.run(spark, SF).count() == len(ids[-1])


def test_near_copies_of_five_words_and_80_percent(spark):
    words = [f"w{k}" for k in range(100)]
    copy = words[:40] + [f"x{k}" for k in range(6)] + words[46:]  # one run changed: 86 of 106 five-word runs are shared
    other = words[:40] + [f"y{k}" for k in range(8)] + words[48:]  # 84 of 108
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(other))], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in P.one_of_each_group(spark, docs, SF).collect()) == [1, 3]


def test_names_of_stages_and_queries():
    import __spark_entry__ as E

    assert len(P.STAGES) == 5 and {n.split("_")[0] for n in E.queries() if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in E.queries() and set(E.oracle_sql()) <= set(E.queries())


def test_nothing_else_needs_these_operators():
    import pathlib

    root = pathlib.Path(P.__file__).parent / "grainsift"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
