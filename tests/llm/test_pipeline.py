"""The stages of the pipeline, each on its own input, and all of them against plain Python, SQL and the tiktoken library."""

import base64
import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sievework.llm import language, mixing, substring_dedup
from sievework.llm.common import materialize


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(90_001, "12 34 --", "en", "src1", 8), (90_002, None, None, None, 0)], docs.schema)
    docs = materialize(docs.unionByName(odd), "t")
    kept = materialize(corpus_pipeline.identify_language(spark, docs, sf), "t")
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2 and kept.filter("doc_id > 90000").count() == 0
    firsts = materialize(corpus_pipeline.drop_near_copies(spark, kept, sf), "t")
    assert firsts.columns == docs.columns and 0 < firsts.count() <= kept.count()
    cut = materialize(corpus_pipeline.cut_repeats(spark, firsts, sf), "t")
    removed = {r.doc_id: r for r in substring_dedup.remove_repeats(firsts.select("doc_id", "text")).collect()}
    before = {r.doc_id: r.text for r in firsts.collect()}
    for r in cut.collect():
        want = removed[r.doc_id].kept if removed[r.doc_id].n_removed else before[r.doc_id]
        assert r.text == want and (not removed[r.doc_id].n_removed or r.n_chars == len(want))
    mixed = materialize(corpus_pipeline.mix_sources(spark, cut, sf), "t")
    copies = {r.doc_id: r.copies for r in mixing.taken(cut).collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}
    out = corpus_pipeline.encode(spark, mixed, sf).collect()
    texts = {r.doc_id: r.text or "" for r in cut.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in out) and len(out) == mixed.count()


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_corpus():
    rng = random.Random(8)
    word = lambda: rng.choice("alpha beta gamma delta épsilon zeta".split()) + str(rng.randrange(40))
    passages = [" ".join(word() for _ in range(n)) for n in (18, 20, 33, 60)]
    rows = [(0, None), (1, ""), (2, " \t"), (3, "12 345 -- 6"), (4, "one"), (5, "one"), (6, "word " * 3000)]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 30, 80, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            mine = [word() if rng.random() < 0.01 else w for w in base]
            rows.append((len(rows), rng.choice(["", "  "]) + " ".join(mine)))
    rows += [(len(rows) + k, f"start{k} {rng.choice(passages)}\nmiddle{k} {rng.choice(passages)} end{k}") for k in range(30)]
    rng.shuffle(rows)
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", None]), len(t or "")) for i, t in rows]


def brute_run(rows):
    """(doc_id, source, n_tokens, ids_sha256, decoded_sha256) of the whole pipeline, sorted."""
    docs = {i: (t, source) for i, t, _, source, _ in sorted(rows) if re.search(r"[^\W\d_]", t or "")}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, (t, _) in docs.items() for w in [WORD.findall(t)]}
    root = {i: i for i in sets}
    for _ in sets:
        root = {i: min(root[j] for j in sets if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) for i in sets}
    docs = {i: docs[i] for i in docs if root[i] == i}
    seen, cut = set(), []
    for i, (t, source) in docs.items():
        ws = WORD.findall(t)
        gone = [False] * len(ws)
        for p in range(len(ws) - 19):
            key = tuple(ws[p : p + 20])
            if key in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        cut.append((i, " ".join(w for w, g in zip(ws, gone, strict=True) if not g) if any(gone) else t, source))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(cut, columns=["doc_id", "text", "source"]))
    copies = {doc_id: n for doc_id, n in con.execute(f"SELECT doc_id, copies FROM ({mixing.ORACLE})").fetchall()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t, source in cut:
        ids = lib.encode_ordinary(t)
        out += [(i, source or "", len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] * copies[i]
    return sorted(out), len(root), len(docs), sum(t != docs[i][0] for i, t, _ in cut)


def test_whole_run_against_brute_force(spark, tmp_path):
    rows = brute_corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want, known, firsts, shortened = brute_run(rows)
    assert known == len(rows) - 4 and firsts < known and shortened > 5
    got = [(r.doc_id, r.source or "", r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == want


def test_clashing_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit("x") for c in ("kept", "lang_pred", "others", "n_removed", "body", "score")})
    assert corpus_pipeline.identify_language(spark, docs, sf).columns == docs.columns
    assert corpus_pipeline.cut_repeats(spark, docs, sf).filter("kept = 'x' AND others = 'x'").count() == docs.count()


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
    assert language.learn(docs).languages == []


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 10
