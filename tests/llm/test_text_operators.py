"""Text operators against plain versions, on documents with nulls, copies and odd texts."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from grainsift.llm import decontaminate, jaccard, pieces, substrings, tokenfile

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_groups(texts, size, percent):
    sets = []
    for _, text in texts:
        w = plain_words(ascii_lower(text))
        sets.append({tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    parent = {i: i for i, _ in texts if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(texts):
        for b, (j, _) in enumerate(texts[:a]):
            both = len(sets[a] & sets[b])
            if None not in (i, j) and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(texts, sets)), key=repr)


@pytest.mark.parametrize("size,percent", [(4, 85), (2, 60)])
def test_jaccard_groups(docs, texts, size, percent):
    got = jaccard.link_groups(docs, size, percent)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == plain_groups(texts, size, percent)


@pytest.mark.parametrize("part,block", [(1000, 256), (3, 4)])
def test_jaccard_long_lists_are_compared_in_full(spark, monkeypatch, part, block):
    """Families that share most of the index lists but are only linked in chains."""
    for name, value in (("LONG_LIST", 2), ("LIST_PART", part), ("BLOCK", block), ("SALTS", 2)):
        monkeypatch.setattr(jaccard, name, value)
    base = [f"b{i}" for i in range(40)]
    texts = []
    for k in range(24):
        w = list(base)
        for j in range(k):
            w[j] = f"c{j}"
        texts.append((k, " ".join(w)))
        texts.append((100 + k, " ".join(w + [f"more{i}" for i in range(5 * (k % 4))])))  # of several sizes
    got = jaccard.link_groups(spark.createDataFrame(texts, "doc_id bigint, text string"), 1, 85)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == plain_groups(texts, 1, 85)


def test_jaccard_rows_repeated_for_a_join_are_never_broadcast(spark):
    rows = spark.range(200).selectExpr("id % 5 as token", "id as node")
    met = jaccard._join_few(rows, spark.range(5).filter("id % 2 = 1").selectExpr("id as token", "id * 10 as mark"), "token")
    assert rows_of(met, "token", "node", "mark") == sorted(((k % 5, k, k % 5 * 10) for k in range(200) if k % 5 in (1, 3)), key=repr)
    joins = [x for x in met._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x]
    assert joins and not [x for x in joins if "Broadcast" in x]


def test_jaccard_keeps_one_of_each_group(docs, texts):
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    groups = plain_groups(texts, 4, 85)
    wanted = sorted({i for i, n, c in groups if i is not None and n and c == i})
    got = [r for r in kept.collect()]
    assert sorted(r.doc_id for r in got if r.doc_id is not None and (r.text or "").strip()) == wanted
    assert sum(1 for r in got if not (r.text or "").strip()) == sum(1 for _, t in texts if not (t or "").strip())


def test_repeated_passages(docs, texts):
    first = defaultdict(set)
    for i, text in texts:
        w = plain_words(text)
        for k in range(len(w) - 49):
            if i is not None:
                first[tuple(w[k:k + 50])].add(i)
    wanted = []
    for i, text in texts:
        w, gone = plain_words(text), set()
        for k in range(len(w) - 49):
            if i is not None and min(first[tuple(w[k:k + 50])]) < i:
                gone |= set(range(k, k + 50))
        wanted.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert any(r[2] for r in wanted)
    got = rows_of(substrings.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept")
    assert got == sorted(wanted, key=repr)


@pytest.mark.parametrize("block_bytes", [decontaminate.MAX_BENCHMARK_BYTES, 200])
def test_decontamination(spark, docs, texts, block_bytes):
    items = [(1, " ".join(plain_words(texts[1][1])[:14])), (2, "WORD3 word4"), (3, None), (4, "!!"), (5, texts[30][1]),
             (5, texts[31][1]), (None, texts[32][1]), (6, " ".join(plain_words(texts[1][1])[2:12]))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(t))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9)) if w and item is not None else ():
            windows[tuple(w[k:k + 10])].add(str(item))
    wanted = []
    for i, text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        wanted.append((i, len(w), sorted(hit), sorted(found)))
    assert any(r[2] for r in wanted)
    got = decontaminate.find_passages(docs, benchmark, names=("w_", "h_", "i_"), block_bytes=block_bytes)
    assert rows_of(got, "doc_id", "w_", "h_", "i_") == sorted(wanted, key=repr)
    clean = decontaminate.drop_contaminated(docs, benchmark, block_bytes=block_bytes)
    assert clean.columns == docs.columns and clean.count() == sum(not r[2] for r in wanted)
    cut = decontaminate.remove_passages(docs, benchmark)
    assert cut.columns == docs.columns
    for r in cut.collect():
        assert not any(tuple(words(r.text)[k:k + 10]) in windows for k in range(len(words(r.text)))) or "word" in r.text


def test_empty_benchmark(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.drop_contaminated(docs, none).count() == docs.count()


def test_sentencepiece_is_the_library(docs, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    wanted = []
    for i, text in texts:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        wanted.append((i, len(ids), struct.pack(f"<{len(ids)}I", *ids), library.decode(ids)))
    got = [(i, n, bytes(x), d) for i, n, x, d in rows_of(pieces.encode(docs, PIECES), "key", "n_tokens", "ids", "decoded")]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_sentencepiece_on_odd_texts():
    import random

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table = pieces.table_of(("test", pieces.read_model(PIECES)))
    rng = random.Random(4)
    parts = ["a", "b", "the", " ", "  ", "\n", "▁", "é", "ﬁ", "日", "\U0001f600", "ing", "0", "\t", "<s>", "\0", ",", ".,", "e.g.", "n't", "|"]
    for text in ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 4000, " " * 900]:
        ids, wanted = table.encode(text), library.encode(text, add_bos=True, add_eos=True)
        assert list(memoryview(ids).cast("I")) == wanted, text
        assert table.decode(ids) == library.decode(wanted)
    assert table.decode(struct.pack("<4I", table.byte_ids[0xC3], table.byte_ids[0x28], 1, 300)) == library.decode(
        [table.byte_ids[0xC3], table.byte_ids[0x28], 1, 300])


def test_token_files_round_trip(spark, docs, texts, tmp_path):
    library = Tokenizer.from_file(WORDS)
    folder = str(tmp_path / "tokens")
    tokenfile.write_tokens(docs, folder, WORDS, shards=5)
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [1]
    got = rows_of(tokenfile.read_checksums(spark, folder), "start", "doc_id", "n_tokens", "ids_crc32")
    got.sort()
    assert [r[0] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    assert [r[1] for r in got] == [None, None] + sorted(i for i, _ in texts if i is not None)
    crc = lambda x: zlib.crc32(struct.pack(f"<{len(x)}I", *x))
    assert sorted((r[1:] for r in got), key=repr) == sorted(((i, len(ids(t)), crc(ids(t))) for i, t in texts), key=repr)
    some = tokenfile.read_tokens(spark, folder, 10, 12)
    assert rows_of(some, "doc_id", "token_ids") == sorted(((i, ids(t)) for i, t in texts if i in (10, 11, 12)), key=repr)
    assert rows_of(tokenfile.read_metadata(spark, folder), "start", "n_tokens") == sorted(((r[0], r[2]) for r in got), key=repr)


def test_token_words_like_whole_texts():
    import random

    library = Tokenizer.from_file(WORDS)
    with open(WORDS, encoding="utf-8") as f:
        spec = f.read()
    assert tokenfile.drops_white_space(spec)
    words, rng = tokenfile._words(spec), random.Random(6)
    parts = ["a", "B", "the", " ", ",", ".", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", "|", "É", "İ", "Σ", "1", "²", "!!", "́", "日本", "$", "*"]
    for text in ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(3000)]:
        assert list(memoryview(words.encode([text])[0]).cast("I")) == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("run", [
    lambda d: jaccard.link_groups(d), lambda d: jaccard.keep_first(d), lambda d: substrings.remove_repeats(d),
    lambda d: pieces.encode(d, PIECES), lambda d: tokenfile.token_table(d, WORDS)])
def test_empty_tables(docs, run):
    assert run(docs.limit(0)).count() == 0


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_layout_of_token_files(spark, monkeypatch):
    """Delta pages, several row groups with page indexes, and filters that leave row groups unread."""
    import glob

    import pyarrow.parquet as pq

    from grainsift.session import new_work_dir

    monkeypatch.setattr(tokenfile, "ROW_GROUP_BYTES", 64 << 10)
    monkeypatch.setattr(tokenfile, "PAGE_BYTES", 8 << 10)
    folder = new_work_dir(spark, "layout")
    rows = [(i, " ".join(f"word{(i * 7 + k) % 997}" for k in range(120))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    tokenfile.write_tokens(docs, folder, WORDS, shards=4)
    groups = [(f, k) for f in glob.glob(f"{folder.removeprefix('file:')}/*.parquet") for k in range(pq.ParquetFile(f).num_row_groups)]
    assert len(groups) > 8
    ranges = []
    for f, k in groups:
        group = pq.ParquetFile(f).metadata.row_group(k)
        columns = {group.column(c).path_in_schema.split(".")[0]: group.column(c) for c in range(group.num_columns)}
        assert "DELTA_BINARY_PACKED" in columns["token_ids"].encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index
        ranges.append((columns["doc_id"].statistics.min, columns["doc_id"].statistics.max, columns["token_ids"].total_compressed_size))
    ranges.sort()
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))  # row groups hold ranges of ids
    wanted = sum(size for low, high, size in ranges if high >= 100 and low <= 110)
    assert wanted < 0.2 * sum(size for *_, size in ranges)
    some = tokenfile.read_tokens(spark, folder, 100, 110)
    assert sorted(r.doc_id for r in some.collect()) == list(range(100, 111))
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in plan and "LessThanOrEqual(doc_id,110)" in plan
    meta = tokenfile.read_metadata(spark, folder)
    assert "token_ids" not in meta._jdf.queryExecution().executedPlan().toString()
    assert [r.start for r in meta.orderBy("doc_id").limit(2).collect()][0] == 0


def test_words_of_letters_skip_the_steps_before_the_model(spark, monkeypatch):
    from tokenizers import Tokenizer

    with open(WORDS, encoding="utf-8") as f:
        spec = f.read()
    library = Tokenizer.from_str(spec)
    texts = ["Straße ÀÉÎ,. ÿÆæŒ œuvre", "don't it's L'été", "µm ªº ×÷ ñ Ñandú!?", "A1b2 x|y <|endoftext|> naïve… İstanbul ΣΑΣ été",
             "word Word, WORD!? word", "12 3.5, #tag o'clock'S 'tis", "", "x" * 100, "e\u0301te\u0301 École"]
    monkeypatch.setattr(tokenfile, "KEPT_WORDS", 5)  # tables are renewed all the time
    tokenfile._WORDS.clear()
    asked = []
    for _ in range(3):
        words = tokenfile._words(spec)
        assert words.by_letters and len(words.before) <= 40
        tokenizer, words.tokenizer = words.tokenizer, type("Asked", (), {
            "encode_batch_fast": lambda self, w, **kw: asked.extend(w) or library.encode_batch_fast(w, **kw)})()
        for text in texts:
            ids = library.encode_batch_fast([text], add_special_tokens=False)[0].ids
            assert words.encode([text]) == [b"".join(i.to_bytes(4, "little") for i in ids)]
        words.tokenizer = tokenizer
    assert not {"straße", "word", "naïve", "x" * 100} & set(asked)
    tokenfile._WORDS.clear()
    for change in ('"[\\\\p{L}]+', "NFKC"):
        assert not tokenfile.pieces_are_letters(spec.replace("[\\\\p{L}]+", "[\\\\p{L}]{1,3}") if "p{L}" in change else spec.replace('"NFC"', '"NFKC"'))
