"""The ten operators against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sievework.llm import byte_bpe, common, jaccard_join, language, media, mixing, quality, queries, rans, substring_dedup, suffix_dedup, token_files, topk, webp

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("ab cd efé gh ij kl".split()) + str(rng.randrange(9)) for _ in range(rng.choice([15, 19, 20, 21, 40]))) for _ in range(9)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "x " * 60), (5, "long " * 4000)]
    for k in range(6, n):
        rows.append((k, " ".join(rng.choice([rng.choice(passages), "w" + str(rng.randrange(99)), "y" * rng.randrange(1, 130)]) for _ in range(rng.randrange(0, 7)))))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").withColumns({"source": F.concat(F.lit("s"), F.col("doc_id") % 3), "lang": F.lit("en"), "score": F.lit(1), "kept": F.lit("x")}).repartition(4).cache()


def thue_morse(n, letters):
    return "".join(letters[k.bit_count() & 1] for k in range(n))


def collected(df, *names):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *names).collect()}


def test_substring_dedup(docs):
    seen, want = set(), {}
    for i, t in corpus():
        ws = WORD.findall(t or "")
        gone = [False] * len(ws)
        for p in range(len(ws) - 19):
            key = tuple(ws[p : p + 20])
            if key in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        want[i] = (len(ws), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(ws, gone) if not g).encode()).hexdigest())
    assert collected(substring_dedup.digests(docs), "n_words", "n_removed", "kept_sha256") == want
    assert substring_dedup.digests(docs.limit(0)).count() == 0


def brute_words(rows):
    seen, want = set(), {}
    for i, t in rows:
        ws = WORD.findall(t or "")
        gone = [False] * len(ws)
        for p in range(len(ws) - 19):
            key = tuple(ws[p : p + 20])
            if key in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        want[i] = (len(ws), sum(gone))
    return want


def test_words_made_to_collide(spark):
    """Complementary Thue-Morse words have equal polynomials modulo 2^64 at every odd base."""
    rows = []
    for n in (1024, 2048, 4096):
        for letters in ("ab", "ba"):
            rows.append((len(rows), " ".join([thue_morse(n, letters)] + [f"w{n}x{k}" for k in range(19)])))
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, " ".join("abcdefghijklmno" if k % 2 else "abcdefghijklmnop" for k in range(40)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collected(substring_dedup.digests(df), "n_words", "n_removed")
    assert got == brute_words(rows) and got[1] == (20, 0) and got[6] == (20, 20)
    # One shingle of 16 differs, so the two are near, but no copies.
    classes = collected(jaccard_join.join(df), "class_id", "n_links", "n_copies")
    assert [classes[k] for k in range(8)] == [(0, 2, 2), (0, 2, 1), (2, 1, 1), (2, 1, 1), (4, 1, 1), (4, 1, 1), (0, 2, 2), (7, 0, 1)]


def test_span_numbers_hold_short_spans():
    rng = random.Random(8)
    words = [bytes(rng.choice([0, 1, 97, 255]) for _ in range(rng.randrange(0, 20))) for _ in range(4000)]
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    low, high = common.span_numbers(np.frombuffer(b"".join(words), np.uint8), at[:-1], at[1:])
    both = dict(zip(zip(low.tolist(), high.tolist()), words))
    assert len(both) == len(set(words)) and all(both[a, b] == w for a, b, w in zip(low.tolist(), high.tolist(), words))


def test_cover_has_every_difference():
    places = np.flatnonzero(substring_dedup.COVER)
    assert {(a - b) % substring_dedup.PERIOD for a in places for b in places} == set(range(substring_dedup.PERIOD))


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(docs, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    seen, want = set(), {}
    for i, t in corpus():
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        runs = int((np.diff(np.concatenate([[0], gone, [0]]).astype(int)) == 1).sum())
        want[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    assert collected(suffix_dedup.digests(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_refinement_equals_comparison():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    text[1000:1300] = text[100:400]
    ends = np.repeat([1500, 4000], [1500, 2500])
    pointer = suffix_dedup.refine(text, ends, 100)
    by = defaultdict(set)
    for p in range(4000):
        if p + 100 <= ends[p]:
            by[text[p : p + 100].tobytes()].add(int(pointer[p]))
        else:
            assert pointer[p] == -1
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


@pytest.mark.parametrize("unit", [512, 6])
def test_jaccard_join(spark, unit, monkeypatch):
    monkeypatch.setattr(jaccard_join, "UNIT_DOCS", unit)
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, "a b"), (3, "a  b"), (4, "a b c d e")]
    for _ in range(10):
        base = [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(rng.choice([20, 60, 200]))]
        for _ in range(rng.choice([1, 2, 25])):
            ws = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                ws[rng.randrange(len(ws))] = "z"
            rows.append((len(rows), " ".join(ws)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := WORD.findall(t or "")) else set() for i, t in rows}
    links = {i: {j for j in sets if j != i and sets[i] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))} for i in sets}
    root = {i: i for i in sets}
    for _ in sets:
        root = {i: min([root[i], *(root[j] for j in links[i])]) for i in sets}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collected(jaccard_join.join(df), "class_id", "n_links") == {i: (root[i], len(links[i])) for i in sets}
    assert {r.doc_id for r in jaccard_join.first_of_each_class(df.unionByName(df)).collect()} == set(root.values())
    assert jaccard_join.first_of_each_class(df.unionByName(df)).count() == len(set(root.values()))


def test_pruning_tolerance():
    assert jaccard_join.least_agreements(32, 0.8) < 0.8 * 32 and jaccard_join.least_agreements(128, 0.8, 0.5) > jaccard_join.least_agreements(128, 0.8)


def test_topk_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = sorted(map(tuple, queries.op5_topk(spark, sf).collect()))
    assert got == sorted(con.execute(queries.OP5_SQL).fetchall())


@pytest.mark.parametrize("held", [topk.HELD, 100_000, 0])
def test_topk_carries_scores_between_shards(spark, monkeypatch, held):
    """Many shards in a task, many ties, and bounds carried for all, some or no blocks of queries."""
    monkeypatch.setattr(topk, "HELD", held)
    x = np.random.default_rng(5).integers(-3, 4, (20_000, 3))
    df = spark.createDataFrame(list(enumerate((x / 256.0).tolist())), "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 50 == 0, 4).orderBy("query_id", "rank").collect()]
    want = []
    for query in range(0, len(x), 50):
        scores = x @ x[query]
        scores[query] = -1000
        best = np.lexsort((np.arange(len(x)), -scores))[:4]
        want += [(query, k + 1, int(i), int(scores[i])) for k, i in enumerate(best)]
    assert got == want


def test_topk_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (50, [1.0]), (51, [2.0]), (100, [1e12, -1e5]), (None, [1.0, 2.0]), (1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, 3).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(0, 1, 100, 65535986892800000), (0, 2, 1, 327680), (0, 3, 1, 327680)] and got[3] == (50, 1, 51, 131072)
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0, 3).count() == 0


def test_topk_copies_are_bounded(spark, monkeypatch):
    """Vectors are kept in 16 bits a component, and however small the units, copies of the queries weigh little more than the vectors."""
    x = np.random.default_rng(5).integers(-3, 4, (40_000, 3))
    df = spark.createDataFrame(list(enumerate((x / 256.0).tolist())), "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "SHARD_ROWS", 400)
    packed = topk.pack(df, F.col("vec_id") % 5 == 0, 4)
    assert packed.filter("kind = 0").agg(F.sum(F.length("vectors"))).first()[0] == 2 * x.size
    monkeypatch.setattr(topk, "UNIT_BYTES", 1)
    units = topk._units(packed, 100).first()
    assert units["units"] == 10 and units["units"] * packed.filter("kind = 1").agg(F.sum(F.length("vectors"))).first()[0] <= topk.COPIES * 2 * x.size


def test_topk_in_two_rounds(spark, tmp_path):
    """Units enough for two rounds, with copies and so ties among them."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[1000:1300] = x[50]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 64), pa.int32()), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": lists}), tmp_path / "v.parquet", row_group_size=20_000)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(spark.read.parquet(str(tmp_path / "v.parquet")), F.col("vec_id") % 50 == 0, 5).collect()}
    e = np.floor(256 * x.astype(np.float64))
    queries_ = np.arange(0, len(x), 50)
    assert len(got) == 5 * len(queries_)
    for query in queries_[:200].tolist() + queries_[-100:].tolist():
        scores = e @ e[query]
        scores[query] = -np.inf
        best = np.lexsort((np.arange(len(x)), -scores))[:5]
        assert [got[query, k + 1] for k in range(5)] == [(i, scores[i]) for i in best.tolist()]


def test_byte_bpe(docs):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in corpus():
        ids = lib.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    columns = ("n_tokens", "ids_sha256", "decoded_sha256")
    assert collected(byte_bpe.digests(docs, path, public_tokenizers.PATTERN), *columns) == want
    out = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in out.collect()} == {i: (t or "").encode() for i, t in corpus()}
    text = "a  b c\n\n d's  é " * 300
    assert [x for p in byte_bpe.ByteBPE.cut(text, 50) for x in lib.encode_ordinary(p)] == lib.encode_ordinary(text)


def test_mixing_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.taken(df)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(mixing.ORACLE).df()[got.columns].itertuples(index=False, name=None))
    by = got.join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("size")).collect()
    assert all(abs(r.taken - r.target) <= r["size"] for r in by)


def test_mixing_odd_rows(docs, spark):
    odd = docs.withColumn("source", F.when(F.col("doc_id") % 4 > 0, F.col("source")))
    out = mixing.taken(odd).collect()
    assert len(out) == len(corpus()) and all(0 <= r.taken <= 2 * r["size"] for r in out)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.taken(odd).collect()))
    assert mixing.taken(odd.limit(0)).count() == 0 and mixing.mix(odd).columns == odd.columns


@pytest.mark.parametrize("n, k", [(0, 1), (1, 1), (5, 3), (2048, 1), (2049, 400), (300_000, 40_000)])
def test_rans(n, k):
    ids = (np.random.default_rng(n).zipf(1.3, n) % k).astype(np.uint32) * 7
    data = rans.write_file(np.array([4]), np.array([True]), np.array([n]), ids)
    file = rans.File(data)
    assert (file.ids() == ids).all()
    if n > 200_000:
        assert (file.blocks(1, 2) == ids[rans.BLOCK_IDS :]).all()
        with pytest.raises(ValueError):
            rans.File(data[: file.base + 99] + bytes([data[file.base + 99] ^ 1]) + data[file.base + 100 :]).blocks(0, 1)


def test_token_files(docs, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "FILE_IDS", 700)
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    odd = ["a <|endoftext|> b", "<|startoftext|><|endoftext|>x", "<|endoftext|", "|>", "<|ENDOFTEXT|>", "É<|endoftext|>́e"]
    odd += [thue_morse(k, "ab") + " " + thue_morse(k, "ba") for k in (1024, 2048, 4096)]
    rows = [*corpus(), *enumerate(odd, 1000)]
    docs = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(rows[-len(odd) :], "doc_id long, text string"))
    want, start = {}, 0
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert collected(token_files.digests(token_files.write(docs, path)), "start", "n_tokens", "ids_crc32") == want


def test_word_cache_equals_library():
    from sievework.llm.word_cache import WordCache

    rng = random.Random(3)
    letters = list("abZÉéß×÷µª²½,.-'\"!?(){}019 \t\n\x0b\x1c\x85\xa0ŁΣς你ǅİ́​“”…😀＂")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["it's 'S x.'s '-s don't", "<|endoftext|>a", "b<|startoftext|>.<|endoftext|><|endoftext", "|>"]
    cache = WordCache(public_tokenizers.path("word_bpe_49k.json"))
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    ids, counts = cache.encode(np.frombuffer(b"".join(raw), np.uint8), at, 1)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert got == [[*lib.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_quality(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice("the house river stone bright many people walked slowly".split()) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["A|B", "###", "$$$", "XX!!"]) for _ in range(60))
    rows = [(k, good() if k % 3 else bad()) for k in range(600)] + [(600, None), (601, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(600)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    out = {r.doc_id: r for r in quality.scores(df, model).collect()}
    assert len(out) == 602 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    held = [k for k in range(600) if out[k].held_out]
    assert held == [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(out[k].predicted == int(k % 3 > 0) for k in held) >= 0.97 * len(held)
    assert quality.fit(df, labels.limit(0)) is None and quality.scores(df, None).first().score == 0.5


def test_language(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    out = language.predict(df, language.learn(df)).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.9 * len(out)
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 --", "fr"), (None, "hello", "en"), (4, "a", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.predict(odd, language.learn(odd)).collect()} == {"und"}


def test_discriminant_against_formulas():
    """Scores from dense covariances, determinants and inverses instead of cached Cholesky factors."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 1, (80, 4)) @ rng.normal(0, 1, (4, 4)), rng.normal(1, 2, (30, 4))])
    y = np.repeat([0, 1], [80, 30])
    model = quality.Discriminant.fit(x, y)
    z = (x - x.mean(0)) / x.std(0)
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = (80 * own[0] + 30 * own[1]) / 110
    log = []
    for k, n in ((0, 80), (1, 30)):
        share = n / (n + 4)
        c = (1 - quality.TO_POOLED) * (share * own[k] + (1 - share) * pooled) + quality.TO_POOLED * pooled
        c = (1 - quality.TO_DIAGONAL) * c + quality.TO_DIAGONAL * np.diag(np.diag(c)) + 1e-3 * np.eye(4)
        d = z - z[y == k].mean(0)
        log.append(np.log(n / 110) - 0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.log(np.linalg.det(c))))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(log[0] - log[1])))


def area(scores, labels):
    """The share of pairs of unlike labels that the scores order rightly."""
    good, bad = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_quality_of_held_out_labels(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.scores(docs, quality.fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert area([r.score for r in rows], [r.quality for r in rows]) > 0.75
    again = docs.unionByName(docs).unionByName(docs.limit(0))
    assert quality.fit(again, labels).means.tolist() == quality.fit(docs, labels).means.tolist()
    assert quality.scores(docs.limit(0), None).count() == 0


def test_language_against_brute_force(spark):
    """Profiles and out-of-place distances by counting in plain Python."""
    rng = random.Random(12)
    alphabets = {"aa": "abcdefg ", "bb": "efghijk ", "cc": "ёжзийкл "}
    rows = [(k, "".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(1, 200))) + rng.choice(["", " 12-3", "É"]), lang) for k in range(150) for lang in [rng.choice(sorted(alphabets))]]
    rows += [(200, "abc ABC", None), (201, "77", "aa"), (202, "efg", "bb"), (203, "efg", "bb")]

    def grams(text):
        out = Counter()
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f" {word} "
            out.update(g for n in (1, 2, 3) for a in range(len(padded) - n + 1) if (g := padded[a : a + n]).strip())
        return out

    def ranked(counts):
        number = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(g))
        return sorted(counts, key=lambda g: (-counts[g], number(g)))[: language.PROFILE]

    profiles = {}
    for k, text, lang in rows:
        if lang and zlib.crc32(str(k).encode()) % 5:
            profiles.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: {g: r for r, g in enumerate(ranked(c))} for lang, c in profiles.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language.predict(df, language.learn(df)).collect()}
    for k, text, _ in rows:
        mine = ranked(grams(text))
        apart = {lang: sum(abs(p[g] - r) if g in p else language.PROFILE for r, g in enumerate(mine)) for lang, p in profiles.items()}
        want = min(sorted(apart), key=apart.get) if mine else "und"
        assert out[k].lang_pred == want and (mine or out[k].score == 0), (k, text, apart)


def vp8l(writer):
    chunk = writer.bytes()
    return b"RIFF" + (12 + len(chunk) + (len(chunk) & 1)).to_bytes(4, "little") + b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + chunk + b"\0" * (len(chunk) & 1)


def put_plain_image(w, argb, top=True):
    """Literal pixels under flat 8-bit codes."""
    w.put(0, 1)
    if top:
        w.put(0, 1)
    for extra in (24, 0, 0, 0):
        webp.put_prefix_code(w, [8] * 256 + [0] * extra)
    w.put(1, 1), w.put(0, 1), w.put(0, 1), w.put(0, 1)
    for a, r, g, b in argb:
        for v in (g, r, b, a):
            w.put(int(f"{v:08b}"[::-1], 2), 8)


def started(width, height, alpha=1):
    w = webp.BitWriter()
    w.put(webp.SIGNATURE, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(alpha, 1), w.put(0, 3)
    return w


def test_media(docs):
    out = {r.doc_id: r for r in media.round_trip(docs).collect()}
    for i, t in corpus():
        b = (t or "").encode()
        padded = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        grid = np.frombuffer(padded, np.uint8).reshape(-1, 576).astype(float)
        assert r.feature.startswith(f"576x{len(grid)};mean={grid.mean():.3f};sd={grid.std():.3f};ahash=")
    assert len({out[i].media_sha256 for i in (0, 1)}) == 1
    stored = media.store(docs)
    for r in stored.collect():
        assert (out[r.doc_id].media_sha256, out[r.doc_id].media_bytes) == (hashlib.sha256(r.media).hexdigest(), len(r.media))
    loaded = media.load(stored).filter("doc_id = 4").first()
    assert bytes(loaded.payload).startswith(b"x x ")
    images = media.pixels(stored).filter("doc_id = 4").collect()
    assert [(r.number, r.height, r.width, bytes(r.argb[:4])) for r in images] == [(0, 1, 576, b"\xffxxx")]
    assert media.round_trip(docs.limit(0)).count() == 0


def test_media_of_a_very_long_text():
    text = np.frombuffer(("".join(f"line {k} of many\n" for k in range(90_000))).encode(), np.uint8)
    stored = media.to_media(text, np.array([0, len(text), len(text)]))
    back = media.from_media(stored)
    assert back[0][: len(text)] == text.tobytes() and back[1] == b"\xff" * 576 and len(stored[0]) < len(text) / 2


@pytest.mark.parametrize("fewest", [1, 24])
def test_webp_payloads(fewest, monkeypatch):
    monkeypatch.setattr(webp, "FEWEST", fewest)
    rng = np.random.default_rng(5)
    texts = [b"\xff" * 576, b"ab" * 288, bytes(range(16)) * 36, b"The quick brown fox \xc3\xa9 \n" * 500, rng.integers(0, 256, 5760).astype(np.uint8).tobytes(), b"\0" * 1152, rng.choice([48, 49], 5760).astype(np.uint8).tobytes(), "Быстрая лиса 狐 ".encode() * 90]
    texts = [t[: len(t) // 576 * 576] for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    files = webp.encode_payloads(np.frombuffer(b"".join(texts), np.uint8), at)
    assert webp.decode_payloads(files) == texts and sum(map(len, files[:4])) < 2000
    kinds = {f.__name__ for x in files for f, _ in webp.parse(x).undo}
    assert kinds == {"_undo_subtract_green", "_undo_palette"}
    for f, t in zip(files, texts):
        picture = webp.parse(f)
        # Pixel by pixel, the same as side by side; all channels but alpha hold the byte.
        slow = webp._finished(picture, webp._channels(webp._pixels(picture.bits, picture.codes, picture.packed_width, picture.height)))
        got = webp.decode(f)
        assert (slow == got).all() and (got[:, :, 0] == 255).all() and all(got[:, :, c].tobytes() == t for c in (1, 2, 3))
    with pytest.raises(ValueError):
        webp.decode(files[4][:600])


def test_webp_transforms():
    rng = random.Random(6)
    w_, h_ = 7, 6
    pixels = [tuple(rng.randrange(256) for _ in range(4)) for _ in range(w_ * h_)]
    w = started(w_, h_)
    w.put(0, 1)
    put_plain_image(w, pixels)
    assert webp.decode(vp8l(w)).reshape(-1, 4).tolist() == [list(p) for p in pixels]
    # Predictor: every mode, undone by adding the guess to what is stored.
    for mode in range(14):
        w = started(w_, h_)
        w.put(1, 1), w.put(webp.PREDICTOR, 2), w.put(1, 3)
        put_plain_image(w, [(255, 0, mode, 0)] * 1, False)
        w.put(0, 1)
        put_plain_image(w, pixels)
        got = webp.decode(vp8l(w)).astype(int)[:, :, [3, 2, 1, 0]].reshape(-1, 4).tolist()
        stored = [[p[3], p[2], p[1], p[0]] for p in pixels]
        for k in range(1, len(got)):
            y, x = divmod(k, w_)
            guess = got[k - 1] if not y else got[k - w_] if not x else webp._predict(mode, got[k - 1], got[k - w_], got[k - w_ + 1], got[k - w_ - 1])
            assert got[k] == [(s + g) & 255 for s, g in zip(stored[k], guess)]
    # Cross colour.
    w = started(1, 1)
    w.put(1, 1), w.put(webp.CROSS_COLOUR, 2), w.put(0, 3)
    put_plain_image(w, [(255, 32, 64, 16)], False)  # red to blue 32, green to blue 64, green to red 16
    w.put(0, 1)
    put_plain_image(w, [(255, 10, 100, 20)])
    a, r, g, b = webp.decode(vp8l(w))[0, 0].tolist()
    assert (a, r, g, b) == (255, 10 + (16 * 100 >> 5), 100, (20 + (64 * 100 >> 5) + (32 * 60 >> 5)) & 255)
    # Palette of four colours: four pixels in a byte.
    table = [(255, 0, 0, 0), (255, 10, 20, 30), (255, 200, 100, 50), (0, 1, 2, 3)]
    w = started(5, 1)
    w.put(1, 1), w.put(webp.PALETTE, 2), w.put(3, 8)
    put_plain_image(w, [table[0]] + [tuple((x - y) & 255 for x, y in zip(table[k], table[k - 1])) for k in (1, 2, 3)], False)
    w.put(0, 1)
    put_plain_image(w, [(0, 0, 0b11100100, 0), (0, 0, 0b10, 0)])
    assert [tuple(p) for p in webp.decode(vp8l(w))[0].tolist()] == [table[0], table[1], table[2], table[3], table[2]]


def test_webp_back_references_and_cache():
    # Pixels A B, then 6 pixels copied from 2 before, then A from the colour cache.
    a, b = 0xFF102030, 0xFF405060
    w = started(9, 1)
    w.put(0, 1)
    w.put(1, 1), w.put(4, 4), w.put(0, 1)
    where = [(0x1E35A7BD * c & 0xFFFFFFFF) >> 28 for c in (a, b)]
    lengths = [0] * (280 + 16)
    symbols = (0x20, 0x50, 256 + 4, 280 + where[0])  # length prefix 4: 5 to 6 with one extra bit
    for s in symbols:
        lengths[s] = 2
    webp.put_prefix_code(w, lengths)
    for pair in ((0x10, 0x40), (0x30, 0x60)):
        webp.put_prefix_code(w, [1 if k in pair else 0 for k in range(256)])
    w.put(1, 1), w.put(0, 1), w.put(1, 1), w.put(255, 8)
    distance = [0] * 40
    code = next(k for k in range(1, 121) if webp.NEAR[k - 1] == (2, 0))
    # The prefix of that distance code, and its extra bits.
    prefix = code - 1 if code <= 4 else next(p for p in range(4, 40) if ((2 + (p & 1)) << ((p - 2) >> 1)) < code <= ((2 + (p & 1)) << ((p - 2) >> 1)) + (1 << ((p - 2) >> 1)))
    distance[prefix] = distance[0 if prefix else 1] = 1
    webp.put_prefix_code(w, distance)
    codes = webp.canonical(lengths)
    put = lambda s: w.put(int(codes[s]), 2)
    put(0x20), w.put(0, 1), w.put(0, 1)
    put(0x50), w.put(1, 1), w.put(1, 1)
    put(256 + 4), w.put(1, 1)
    w.put(int(webp.canonical(distance)[prefix]), 1)
    if prefix >= 4:
        w.put(code - 1 - ((2 + (prefix & 1)) << ((prefix - 2) >> 1)), (prefix - 2) >> 1)
    put(280 + where[0])
    got = webp.decode(vp8l(w))[0].astype(np.uint32)
    argb = (got[:, 0] << 24 | got[:, 1] << 16 | got[:, 2] << 8 | got[:, 3]).tolist()
    assert argb == [a, b] * 4 + [a]


def test_shared_folder_is_read_from_the_session(spark):
    assert common.shared_folder(spark)
