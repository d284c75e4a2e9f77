"""The registered queries over small tables with odd rows, against plain computations; over empty tables; clashing columns, text ids."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken.load
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siftstone.llm import bpe, decontamination, exact_dedup, lm_scoring, near_dedup, queries, token_counts, toxicity
from tests.llm.test_operators import ITEMS, LEAKS, ODD, exact_brute, frame, near_brute, prose, toxic_corpus

CLASHING = ["row", "hash", "node", "bucket", "name", "level", "chunk", "target", "n", "t", "shard", "slot", "digest", "payload", "score", "n_bytes", "n_tokens", "ids", "y", "feature", "set_id", "id", "size"]


def write(spark, path, docs, labels, items=ITEMS):
    odd = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    odd(docs, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("bigint")}).write.parquet(f"{path}/documents.parquet")
    odd(labels, "doc_id bigint, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{path}/labels.parquet")
    odd(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, labels, _ = toxic_corpus(300)
    rng = random.Random(1)
    rows = [*docs, *((10_000 + i, t) for i, t in LEAKS if i is not None), *((i, t) for i, t in ODD if i is None), (20_000, "".join(prose(rng, 2000) for _ in range(20)))]
    path = str(tmp_path_factory.mktemp("sf"))
    write(spark, path, rows, labels)
    return path, rows


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    write(spark, path, [], [], [])
    return path


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_of_empty_tables(spark, empty, name):
    made = queries.queries()[name](spark, empty)
    assert made.count() == 0 and len(made.columns) >= 4


def test_pipeline_of_an_empty_table(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_op1(spark, tables):
    path, rows = tables
    got = queries.op1_sharding(spark, path).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for i, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_op3(spark, tables):
    path, _ = tables
    assert {(r.doc_id, r.item_id) for r in queries.op3_decontamination(spark, path).collect()} == {(10_001, 1), (10_002, 1), (10_003, 1), (10_004, 2), (10_007, 3)}


def test_op4(spark, tables):
    path, rows = tables
    got = queries.op4_lm_scoring(spark, path).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert all(r.score == pytest.approx(r.background_loss - r.target_loss) for r in got)


def test_op6(spark, tables):
    path, rows = tables
    ranks = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tiktoken.load.load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((i, len(x := ranks.encode(t or "", disallowed_special=())), sha(" ".join(map(str, x)).encode()), sha((t or "").encode())) for i, t in rows)
    assert Counter(map(tuple, queries.op6_byte_bpe(spark, path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want


def test_op7(spark, tables):
    path, rows = tables
    got = queries.op7_toxicity(spark, path).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def test_op9(spark, tables):
    path, rows = tables
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    got = queries.op9_token_files(spark, path).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x := ids(t)), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in rows)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)


def test_op10(spark, tables):
    path, rows = tables
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    want = Counter((i, len((t or "").encode()), n := count(t), n > 1024) for i, t in rows)
    got = queries.op10_token_counts(spark, path).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert Counter(map(tuple, got)) == want and any(r.over_limit for r in got)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with text ids, among them repeated and null ones, and columns of names that operators use themselves."""
    rng = random.Random(2)
    rows = [(f"d{i % 40}", prose(rng, rng.randint(1, 60))) for i in range(60)] + [(None if i is None else f"o{i}", t) for i, t in ODD]
    rows += [("copy", rows[3][1]), ("near", rows[3][1] + " more")]
    return rows, frame(spark, rows, "doc_id string, text string").withColumns({c: F.lit(7) for c in CLASHING}).persist()


def test_text_ids_and_clashing_columns(spark, odd):
    rows, docs = odd
    ids = Counter(i for i, _ in rows)
    codec = bpe.Codec.from_json(public_tokenizers.path("byte_bpe_50k.json"))
    assert Counter(map(tuple, near_dedup.near_groups(docs, 2, 80).collect())) == near_brute(rows, 2, 80)
    got = exact_dedup.exact_groups(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == exact_brute(rows)
    target = spark.createDataFrame([("d1",), ("d2",)], "x string")
    assert Counter(r.doc_id for r in lm_scoring.cross_entropy_difference(docs, target).collect()) == ids
    assert Counter(r.doc_id for r in token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()) == ids
    assert Counter((r.doc_id, bytes(r.decoded)) for r in bpe.round_trip(docs, codec).collect()) == Counter((i, (t or "").encode()) for i, t in rows)
    items = frame(spark, [("item", clean := rows[0][1] + " and seven more words of this item here")], "item_id string, text string").withColumns({c: F.lit(1) for c in CLASHING if c != "text"})
    found = decontamination.contaminated(docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit("holds"), "text": F.lit(f"before {clean} after")})), items).collect()
    assert [(r.doc_id, r.item_id) for r in found if r.doc_id == "holds"] == [("holds", "item")]


def test_fit_takes_one_text_for_each_id(spark):
    docs, labels, truth = toxic_corpus(400)
    flood = [(labels[0][0], "flood of rows with one id")] * 500
    rows = frame(spark, docs + flood).withColumns({c: F.lit(7) for c in CLASHING})
    labelled = frame(spark, labels, "doc_id bigint, toxic int")
    model = toxicity.fit(rows, labelled)
    scored = {r.doc_id: r.score for r in toxicity.score(frame(spark, docs), model).collect()}
    assert sum((scored[i] >= 0.3) == (i in truth) for i, _ in docs) / len(docs) > 0.95


def test_regression_stands_where_its_gradient_is_nothing():
    rng = np.random.default_rng(3)
    n, d = 300, 12
    x = rng.random((n, d)) < 0.2
    target, weight = rng.random(n), rng.random(n) + 0.5
    rows, cols = np.nonzero(x)
    w, b = toxicity._regression(rows, cols, n, d, target, weight, l2=1.0)
    error = weight * (1 / (1 + np.exp(-(x @ w + b))) - target)
    assert np.abs(x.T @ error + w).max() < 1e-3 and abs(error.sum()) < 1e-3


def test_label_model_matches_plain_expectation_maximisation():
    rng = random.Random(6)
    votes = [[rng.choice((-1, 0, 1)) for _ in range(3)] for _ in range(200)]
    start = [0.8 if v[0] == 1 else 0.1 for v in votes]
    share, p = sum(start) / 200, start
    model = toxicity.fit_label_model(np.array(votes), np.array(start), np.ones(200), rounds=1)
    for c in (0, 1):
        mass = [(x if c else 1 - x) for x in p]
        for j in range(3):
            table = [(sum(m for m, v in zip(mass, votes, strict=True) if v[j] == k) + 0.1) / (sum(mass) + 0.3) for k in (-1, 0, 1)]
            assert model.table[j, c] == pytest.approx(np.array(table) / sum(table), abs=1e-6)
    assert model.shares == pytest.approx([1 - share, share])
