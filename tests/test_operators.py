"""Chunking, retrieval, attribution, evaluation and preparation against plain Python and hand-computed values."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftstone.config import EngineConfig
from siftstone.operators import answer, attribution, chunk, embed, evaluate, prepare, retrieve
from siftstone.streaming.rates import rolling_count

# --- chunks ------------------------------------------------------------------------------------------------------------


@given(st.text(alphabet="ab \n.#", max_size=400), st.integers(5, 60), st.integers(0, 4))
@settings(max_examples=300, deadline=None)
def test_structured_chunks(text, size, overlap):
    chunks = chunk.split_structured(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    bare = lambda t: re.sub(r"\s", "", t)
    if overlap == 0:
        assert bare("".join(chunks)) == bare(text)
    at = 0
    for c in chunks:  # in order, each a part of the text
        assert c in text
        assert text.find(c, max(0, at - size)) >= 0
        at = text.find(c, max(0, at - size))
    assert set(bare(text)) == set(bare("".join(chunks)))
    assert chunks == chunk.split_structured(text, size, overlap)


def test_text_that_fits_is_one_chunk():
    assert chunk.split_structured("## A\n\nb. c d") == ["## A\n\nb. c d"]
    assert chunk.split_structured("") == []
    assert chunk.split_structured("x\n## A\ny\n## B\nz", 7, 0) == ["x", "## A\ny", "## B\nz"]


def test_numbers_run_through_pages_and_skip_short_chunks(spark):
    rows = [("f", 2, "T", "b" * 80), ("f", 1, "T", "a" * 79), ("f", 1, "T", "a" * 160), ("g", None, "", "c" * 100), ("g", 3, "", " " * 200)]
    got = chunk.build_chunks(spark.createDataFrame(rows, "source string, page int, title string, text string"), EngineConfig(chunk_size=100, chunk_overlap=0), "naive").collect()
    assert Counter((r.source, r.page, r.chunk_index, r.char_count) for r in got) == Counter([("f", 1, 0, 100), ("f", 2, 1, 80), ("g", None, 0, 100)])
    assert {r.content.split("\n")[0] for r in got} == {"[T - p.1]", "[T - p.2]", "[g]"}


def test_chunk_stats(spark):
    make = lambda sizes: spark.createDataFrame([("s" if n % 2 else None, n) for n in sizes], "source string, char_count int")
    assert tuple(chunk.chunk_stats(make([1, 2, 3, 4])).first()) == (4, 2, 1, 3, 4, 2)
    assert tuple(chunk.chunk_stats(make([5, 1, 3])).first()) == (3, 1, 1, 3, 5, 3)
    assert tuple(chunk.chunk_stats(make([])).first()) == (0, 0, None, None, None, None)


# --- retrieval ----------------------------------------------------------------------------------------------------------


def test_knn_ranks_ties_by_id(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(200)]
    frame = spark.createDataFrame(vectors, "id bigint, vector array<double>").repartition(5)
    for metric in ("l2", "cosine"):
        got = retrieve.knn(frame.where("id < 10").withColumnRenamed("id", "qid"), frame, 7, metric).collect()

        def distance(a, b, metric=metric):
            a, b = np.array(a), np.array(b)
            norms = np.linalg.norm(a) * np.linalg.norm(b)
            return round(float(np.linalg.norm(a - b)) if metric == "l2" else float(1 - (a @ b / norms if norms else 0)), 9)

        for q in range(10):
            want = sorted((distance(vectors[q][1], v), i) for i, v in vectors)[:7]
            mine = sorted((r["rank"], r.id) for r in got if r.qid == q)
            assert [i for _, i in mine] == [i for _, i in want]
    assert retrieve.knn(frame.limit(0).withColumnRenamed("id", "qid"), frame, 3).count() == 0
    assert retrieve.knn(frame.where("id < 2").withColumnRenamed("id", "qid"), frame.limit(0), 3).count() == 0


def test_mmr(spark):
    rng = np.random.default_rng(1)
    rows = [(1, i, r + 1, float(s), rng.normal(size=3).tolist()) for r, (i, s) in enumerate(zip(range(12), sorted(rng.random(12), reverse=True), strict=True))]
    frame = spark.createDataFrame(rows, "qid bigint, id bigint, rank int, sim double, vector array<double>")
    cosine = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    chosen = [0]
    while len(chosen) < 5:
        rest = [r for r in rows if r[1] not in chosen]
        chosen.append(max(rest, key=lambda r: 0.4 * r[3] - 0.6 * max(cosine(r[4], rows[c][4]) for c in chosen))[1])
    assert [r.id for r in retrieve.mmr(frame, 5, 0.4).orderBy("rank").collect()] == chosen
    assert [r.id for r in retrieve.mmr(frame, 5, 1.0).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_bm25_is_a_full_ranking(spark):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice("a b c d e f g h common".split() + ["common"] * 4) for _ in range(rng.randint(0, 9))) for i in range(30)}
    questions = {1: "a a common", 2: "zzz", 3: "common", 4: "b c d e f g h a"}
    docs = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    asked = spark.createDataFrame(list(questions.items()), "qid bigint, question string")
    n, lengths = len(texts), {i: len(t.split()) for i, t in texts.items()}
    average = sum(lengths.values()) / n
    df = Counter(w for t in texts.values() for w in set(t.split()))
    raw = {w: math.log((n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    idf = {w: 0.25 * sum(raw.values()) / len(raw) if x < 0 else x for w, x in raw.items()}
    for k in (3, 30, 40):
        got = retrieve.bm25(docs, retrieve.bm25_terms(docs), asked, k).collect()
        for q, question in questions.items():
            score = {i: round(sum(idf.get(w, 0) * (f := t.split().count(w)) * 2.5 / (f + 1.5 * (0.25 + 0.75 * lengths[i] / average)) for w in question.split()), 9) for i, t in texts.items()}
            want = sorted(texts, key=lambda i: (-score[i], i))[:k]
            assert [r.id for r in sorted((r for r in got if r.qid == q), key=lambda r: r["rank"])] == want


def test_bm25_in_blocks_of_questions_and_documents(spark, monkeypatch):
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice("a b c d e f".split()) for _ in range(rng.randint(0, 6)))) for i in range(50)] + [(50, None)]
    docs = spark.createDataFrame(texts, "id bigint, text string").repartition(3)
    asked = spark.createDataFrame([(q, " ".join(rng.sample("a b c d e f z".split(), 3))) for q in range(20)] + [(20, ""), (21, None)], "qid bigint, question string")
    terms = retrieve.bm25_terms(docs)
    whole = sorted(map(tuple, retrieve.bm25(docs, terms, asked, 4).collect()))
    assert len(whole) == 22 * 4 and terms.documents == 51
    monkeypatch.setattr(retrieve, "BLOCK_BYTES", 300)
    monkeypatch.setattr(retrieve, "CELLS", 20)
    assert sorted(map(tuple, retrieve.bm25(docs, terms, asked, 4).collect())) == whole
    assert retrieve.bm25(docs, terms, asked.limit(0), 4).count() == 0
    assert retrieve.bm25(docs.limit(0), retrieve.bm25_terms(docs.limit(0)), asked, 4).count() == 0


def test_phrases_are_found_where_they_stand(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "one two three"), ("b", "two\nthree"), ("c", None), ("d", "xtwo three two three")], "source string, content string")
    phrases = spark.createDataFrame([(1, "two three"), (2, "one"), (3, ""), (4, None), (5, "two three"), (6, "nowhere")], "qid bigint, phrase string")
    want = {(1, "a"), (1, "d"), (5, "a"), (5, "d"), (2, "a")}
    assert sorted(map(tuple, evaluate.holders(docs, phrases).collect())) == sorted(want)
    assert {(q, s) for s, t in (("a", "one two three"), ("d", "xtwo three two three")) for q in evaluate._finder({"two three": [1, 5], "one": [2]})(t)} == want
    assert evaluate.holders(docs, phrases.limit(0)).count() == 0
    same = "the same first words of two phrases, "
    find = evaluate._finder({same + "one": [1], same + "two": [2, 3], same: [4]})
    assert sorted(find(f"x {same}two")) == [2, 3, 4] and sorted(find(f"{same}one {same}two")) == [1, 2, 3, 4] and find(same[:-2]) == []


def test_suffixes_of_any_length_match(spark):
    sources = spark.createDataFrame([("x/a.md",), ("y/a.md",), ("ba.md",), (None,)], "source string")
    questions = spark.createDataFrame([(1, ["a.md"]), (2, ["x/a.md", "nothing"]), (3, ["/a.md"]), (4, ["longer/than/any/x/a.md"])], "qid bigint, relevant_sources array<string>")
    got = sorted(map(tuple, evaluate.suffix_matches(questions, sources).collect()))
    assert got == sorted([(1, "x/a.md"), (1, "y/a.md"), (1, "ba.md"), (2, "x/a.md"), (3, "x/a.md"), (3, "y/a.md")])


def test_fusion_of_distinct_contents_permutes_the_dense_list(spark):
    rng = random.Random(5)
    rows = [(q, leg, r + 1, c) for q in range(40) for leg in (0, 1) for r, c in enumerate(rng.sample(range(12), 5))]
    legs = [spark.createDataFrame([(q, str(c), c, r) for q, n, r, c in rows if n == leg], "qid bigint, key string, id bigint, rank int") for leg in (0, 1)]
    got = retrieve.fuse([(legs[0], 0.6), (legs[1], 0.4)], 5).collect()
    for q in range(40):
        assert {r.id for r in got if r.qid == q} == {c for a, n, _, c in rows if a == q and n == 0}


def test_fusion_counts_repeats_and_breaks_ties_by_leg(spark):
    leg = lambda rows: spark.createDataFrame(rows, "qid bigint, key string, id bigint, rank int")
    got = retrieve.fuse([(leg([(1, "x", 7, 1), (1, "y", 8, 2), (1, "y", 9, 3)]), 0.5), (leg([(1, "z", 5, 1)]), 0.5)], 3).orderBy("rank").collect()
    assert [(r.key, r.id) for r in got] == [("y", 8), ("x", 7), ("z", 5)]
    assert got[0].score == pytest.approx(0.5 / 62 + 0.5 / 63)


def test_embedders_agree(spark):
    texts = ["a b a", "", None, "Ünï code  x\ty"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    columns = dict(map(tuple, embed.hash_vectors(frame, "id", "text", 16).collect()))
    python = embed.HashingEmbedder(16).embed_documents(texts)
    for i in range(4):
        assert columns[i] == pytest.approx(python[i])
    assert dict(map(tuple, frame.select("id", embed.by_batch(lambda: embed.HashingEmbedder(16))(F.col("text"))).collect()))[0] == pytest.approx(python[0])


def spans_split(text, size, overlap, separators):
    """The splitter once more, on index ranges: pieces are (start, end) of the text, chunks are joined ranges."""

    def cut(a, b, separator):
        marks = [a] + ([i for i in range(a, b) if text.startswith(separator, i, b)] if separator else list(range(a + 1, b)))
        if separator:  # occurrences do not overlap
            kept, at = [a], a
            for i in marks[1:]:
                if i >= at:
                    kept.append(i)
                    at = i + len(separator)
            marks = kept
        ends = marks[1:] + [b]
        return [(x, y) for x, y in zip(marks, ends, strict=True) if y > x]

    def merge(pieces):
        out, first = [], 0
        for k, (_, end) in enumerate(pieces):
            if k > first and end - pieces[first][0] > size:
                out.append((pieces[first][0], pieces[k - 1][1]))
                while first < k and (pieces[k - 1][1] - pieces[first][0] > overlap or end - pieces[first][0] > size):
                    first += 1
        return out + [(pieces[first][0], pieces[-1][1])] if pieces else out

    def split(a, b, separators):
        own = next((s for s in separators if text.find(s, a, b) >= 0), separators[-1])
        rest, out, run = separators[separators.index(own) + 1 :], [], []
        for piece in cut(a, b, own):
            if piece[1] - piece[0] < size:
                run.append(piece)
            else:
                out += merge(run) + (split(*piece, rest) if rest else [piece])
                run = []
        return out + merge(run)

    return [c for x, y in split(0, len(text), list(separators)) if (c := text[x:y].strip())]


def test_structured_splitter_matches_ranges():
    rng = random.Random(17)
    parts = ["\n## ", "\n### ", "\n\n", "\n", ". ", " ", "a", "bb", "word", "x" * 30, "."]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 120)))
        size = rng.randint(5, 60)
        overlap = rng.randint(0, size - 1)
        assert chunk.split_structured(text, size, overlap) == spans_split(text, size, overlap, chunk.SEPARATORS)


def test_small_tables_in_few_files_are_spread(spark, tmp_path, monkeypatch):
    from siftstone.sources import tables

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(20).write.parquet(str(tmp_path / "many"))
    monkeypatch.setattr(tables, "SPREAD_FROM", 1)
    one, many = (spark.read.parquet(str(tmp_path / x)) for x in ("one", "many"))
    assert tables.spread(one).rdd.getNumPartitions() == 8 and tables.spread(one).count() == 1000 and tables.spread(many) is many
    monkeypatch.setattr(tables, "SPREAD_TO", 2)
    assert tables.spread(one) is one


# --- pacing and retries --------------------------------------------------------------------------------------------------


class Flaky:
    def __init__(self, *errors):
        self.errors = list(errors)

    def embed_documents(self, texts):
        if self.errors:
            raise RuntimeError(self.errors.pop(0))
        return [[float(len(t))] for t in texts]


def test_retries():
    waits = []
    assert embed.embed_with_retry(Flaky("429", "retry in 9s, rate"), ["ab"], sleep=waits.append) == [[2.0]]
    assert 2 <= waits[0] <= 3 and 9 <= waits[1] <= 10
    with pytest.raises(RuntimeError, match="denied"):
        embed.embed_with_retry(Flaky("denied"), ["a"], sleep=waits.append)
    with pytest.raises(embed.QuotaExhausted):
        embed.embed_with_retry(Flaky(*["quota"] * 3), ["a"], attempts=3, sleep=waits.append)


def test_what_cannot_be_retried_is_raised_at_once():
    waits = []
    with pytest.raises(RuntimeError, match="denied"):
        embed.embed_with_retry(Flaky("denied", "denied"), ["a"], attempts=5, sleep=waits.append)
    assert waits == [] and embed.pauses(8) == [2, 4, 8, 16, 32, 60, 60] and embed.pauses(1) == []


def test_pacer():
    now = [0.0]
    pacer = embed.Pacer(10, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    pacer.admit(25)  # larger than the ceiling, but nothing else is there
    pacer.admit(1)
    assert 60 < now[0] < 61
    for _ in range(9):
        pacer.admit(1)
    assert now[0] < 61


def test_pacer_never_exceeds_its_ceiling():
    rng, now, left = random.Random(3), [0.0], []
    pacer = embed.Pacer(20, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(200):
        now[0] += rng.choice([0, 0, 1, 7, 30])
        units = rng.randint(1, 12)
        pacer.admit(units)
        left.append((now[0], units))
        assert sum(n for at, n in left if now[0] - 60 <= at) <= 20
    unlimited = embed.Pacer(0, lambda: now[0], lambda s: pytest.fail("waits"))
    for _ in range(5):
        unlimited.admit(1000)


def test_a_ceiling_holds_for_the_whole_job(spark):
    texts = spark.createDataFrame([(str(i), "x" * i) for i in range(40)], "k string, text string").repartition(8)
    got = embed.embed_texts(texts, lambda: embed.HashingEmbedder(8), batch_size=8, per_minute=100_000)
    assert got.count() == 40 and got.rdd.getNumPartitions() == 8
    assert embed.embed_texts(texts, lambda: embed.HashingEmbedder(8), batch_size=8, per_minute=17).rdd.getNumPartitions() == 2


def test_rolling_count(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.randrange(0, 400)) for i in range(200)] + [(900, "c", 0), (901, "c", 60), (902, "c", 121)]
    frame = spark.createDataFrame(rows, "id int, k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.in_window for r in rolling_count(frame, "k", "ts").collect()}
    assert got == {i: sum(b == k and s - 60 <= x <= s for _, b, x in rows) for i, k, s in rows}
    assert (got[901], got[902]) == (2, 1)


# --- attribution ---------------------------------------------------------------------------------------------------------


def attributed(spark, text, passages=("alpha beta gamma delta epsilon zeta eta theta", "completely other words about rivers and mountains")):
    answers = spark.createDataFrame([(1, text)], "answer_id bigint, answer string")
    given = spark.createDataFrame([(1, n, p) for n, p in enumerate(passages, 1)], "answer_id bigint, n int, content string")
    return attribution.attribute(answers, given, embed.by_batch(lambda: embed.HashingEmbedder(64))).first().cited


LONG = "Alpha beta gamma delta epsilon zeta eta theta."


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (LONG, LONG[:-1] + " [1]."),
        ("alpha beta gamma delta epsilon zeta eta theta", "alpha beta gamma delta epsilon zeta eta theta [1]"),
        ("Short.", "Short."),
        ("", ""),
        (LONG + " See [2]", LONG + " See [2]"),
        (LONG + " arr[0] = 1", LONG + " arr[0] = 1"),
        ("# " + LONG, "# " + LONG),
        ("| " + LONG, "| " + LONG),
        ("```\n" + LONG + "\n```", "```\n" + LONG + "\n```"),
        ("x\n```\n" + LONG, "x\n```\n" + LONG),
        (LONG + "  \n" + LONG, LONG[:-1] + " [1].\n" + LONG[:-1] + " [1]."),
        ("Tiny one. " + LONG, "Tiny one. " + LONG[:-1] + " [1]."),
        ("Nothing in this sentence resembles any passage at all!", "Nothing in this sentence resembles any passage at all!"),
    ],
)
def test_attribution(spark, text, want):
    assert attributed(spark, text) == want


def test_attribution_ties_take_the_first_passage_and_no_passage_changes_nothing(spark):
    assert attributed(spark, LONG, (LONG, LONG)).endswith("[1].")
    assert attributed(spark, LONG, ()) == LONG


def test_threshold_is_inclusive(spark):
    sentence = spark.createDataFrame([(1, "s", [1.0, 0.0])], "answer_id bigint, sentence string, vector array<double>")
    passage = spark.createDataFrame([(1, 1, [0.55, math.sqrt(1 - 0.55**2)]), (1, 2, [0.0, 0.0])], "answer_id bigint, n int, vector array<double>")
    assert attribution.best_passages(sentence, passage, 0.55).count() == 1
    assert attribution.best_passages(sentence, passage, 0.551).count() == 0


@pytest.mark.parametrize(("per_place", "want"), [(None, 9), (1000, 1), (100_000, 9)])
def test_the_most_similar_passage_wins_wherever_it_is_unless_places_count(spark, per_place, want):
    sentence = spark.createDataFrame([(1, "s", [1.0, 0.0])], "answer_id bigint, sentence string, vector array<double>")
    passage = spark.createDataFrame([(1, n, [x, math.sqrt(1 - x * x)]) for n, x in ((1, 0.7), (2, 0.1), (9, 0.701))], "answer_id bigint, n int, vector array<double>")
    (best,) = attribution.best_passages(sentence, passage, 0.7005, per_place).collect()
    assert (best.n, best.sim) == (want, 0.701)


# --- evaluation ----------------------------------------------------------------------------------------------------------

Q = "qid bigint, question string, relevant_sources array<string>, must_contain array<string>, tags array<string>"


def test_metrics(spark):
    questions = spark.createDataFrame([(1, "a", ["x"], None, ["t"]), (2, "b", ["x"], None, ["t", "u"]), (3, "c", ["x"], None, [])], Q)
    ranked = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False)], "qid bigint, rank int, relevant boolean")
    by = evaluate.per_question(ranked, questions)
    got = evaluate.metrics(by).first()
    assert (got.questions, got.hit_rate, got.mrr, got.precision) == (3, round(1 / 3, 6), round(0.5 / 3, 6), round(2 / 9, 6))
    assert {tuple(r) for r in evaluate.by_class(by, questions).collect()} == {("t", 1, 2), ("u", 0, 1)}
    none = evaluate.metrics(by.limit(0)).first()
    assert (none.questions, none.hit_rate) == (0, None)


def test_relevance_and_validation(spark):
    chunks = spark.createDataFrame([("docs/a/guide.md", "[Guide]\nText ABC"), ("docs/b/guide.md", "other")], "source string, content string")
    rows = [
        (1, "suffix", ["a/guide.md"], None, []), (2, "both", ["guide.md"], ["abc"], []), (3, "header", ["docs/a/guide.md"], ["[guide]"], []),
        (4, "nowhere", ["c/guide.md", "x.md"], None, []), (5, "no phrase", ["b/guide.md"], ["abc"], []), (6, "empty list", ["uide.md"], [], []),
    ]
    questions = spark.createDataFrame(rows, Q)
    pairs = chunks.crossJoin(questions).where(evaluate.is_relevant(F.col("source"), F.col("content"), F.col("relevant_sources"), F.col("must_contain")))
    assert {(r.qid, r.source[5]) for r in pairs.collect()} == {(1, "a"), (2, "a"), (3, "a"), (6, "a"), (6, "b")}
    assert {(r.qid, r.problem) for r in evaluate.problems(questions, chunks).collect()} == {(4, "unreachable"), (5, "unmatched")}
    assert evaluate.suffix_matches(questions, chunks).where("qid = 2").count() == 2


def test_report_and_delta(spark):
    results = spark.createDataFrame([(0, "first", 10, 0.5, 0.25, 0.1), (1, "last", 12, 0.75, 0.5, 0.2)], "seq int, config string, chunks int, hit_rate double, mrr double, precision double")
    assert evaluate.delta(results).first().delta == 0.25
    assert evaluate.report(results).first().line.split() == ["first", "10", "50.0%", "0.250", "10.0%"]


# --- answers and pages ---------------------------------------------------------------------------------------------------


def test_contexts_and_citations(spark):
    ranked = spark.createDataFrame([(1, 2, "b.md", None, "B", "T", "id2"), (1, 1, "a.md", 3, "A" * 301, None, "id1")], "qid bigint, rank int, source string, page int, content string, title string, chunk_id string")
    assert answer.contexts(ranked).first().context == "[1] (a.md, page 3)\n" + "A" * 301 + "\n\n---\n\n[2] (b.md)\nB"
    got = answer.citations(ranked).first().sources
    assert [c.n for c in got] == [1, 2] and got[0].snippet.endswith("...") and got[1].chunk_id == "id2"


def test_stream_frames(spark):
    (row,) = spark.createDataFrame([("a\n\nb\n\nrest",)], "b string").select(answer.frames(F.col("b")).alias("f")).collect()
    assert row.f.frames == ["a", "b"] and row.f.rest == "rest"


class Echo:
    def complete(self, prompt):
        if "fail" in prompt:
            raise RuntimeError
        return "  " if "blank" in prompt else "rewritten"


def test_condense_falls_back_to_the_question(spark):
    rows = [(1, "q1", None), (2, "q2", "User: hi"), (3, "fail", "User: hi"), (4, "blank", "User: hi"), (5, "q5", "")]
    got = {r.qid: r.search_query for r in answer.condensed(spark.createDataFrame(rows, "qid bigint, question string, history string"), Echo).collect()}
    assert got == {1: "q1", 2: "rewritten", 3: "fail", 4: "blank", 5: "q5"}


def test_prepared_pages(spark):
    pages = [("a/x.md", "# T { #t }\n\n{* ../code/m.py *}\n\n/// note\nbody\n///\n"), ("img/y.md", "no"), ("newsletter.md", "no"), ("z.md", "{* gone.py *}" + "w" * 300)]
    code = [("code/m.py", "print(1)\n")]
    got = {r.rel_path: r for r in prepare.prepare(spark.createDataFrame(pages, "rel_path string, text string"), spark.createDataFrame(code, "path string, text string")).collect()}
    assert set(got) == {"a/x.md", "z.md"}
    assert got["a/x.md"].name == "a__x.md" and (got["a/x.md"].inlined, got["a/x.md"].missing, got["a/x.md"].kept) == (1, 0, False)
    assert "Example (`m.py`):\n\n```python\nprint(1)\n```" in got["a/x.md"].text and "**Note:**" in got["a/x.md"].text
    totals = prepare.totals(prepare.prepare(spark.createDataFrame(pages, "rel_path string, text string"), spark.createDataFrame(code, "path string, text string"))).first()
    assert (totals.written, totals.skipped, totals.inlined) == (1, 1, 1)
