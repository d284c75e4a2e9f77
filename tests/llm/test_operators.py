"""The operators on small tables, against brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftstone.llm import bpe, decontamination, exact_dedup, line_dedup, lm_scoring, near_dedup, sharding, textscan, token_counts, token_files, toxicity
from siftstone.llm.components import components

SCHEMA = "doc_id bigint, text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega ärger école niño".split()
ODD = [(None, "no id at all here"), (None, None), (900, None), (901, ""), (902, " \t\n\x0b"), (903, "one"), (904, "x " * 30_000), (905, "Ünï©ode 👍🏽 　 text\x1c"), (906, "same row"), (906, "same row")]


def prose(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", ", ", ". ", "\n", "  "]) for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    rows: list[tuple[int | None, str | None]] = [(i, prose(rng, rng.randint(1, 120))) for i in range(n)]
    for i in range(n, n + 25):  # exact and near copies
        words = rows[rng.randrange(n)][1].split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
    return rows + ODD


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).persist()


# --- text scanning ---------------------------------------------------------------------------------------------------


def test_words_match_the_pattern_and_do_not_depend_on_place():
    texts = [t for _, t in corpus()]
    found, at = textscan.words(pa.array(texts, pa.string()))
    by_word: dict[str, int] = {}
    for k, text in enumerate(texts):
        want = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        assert len(want) == at[k + 1] - at[k]
        for w, h in zip(want, found[at[k] : at[k + 1]].tolist(), strict=True):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_long_texts_are_scanned_in_pieces(monkeypatch):
    text = "abc defg " * 1000
    whole, _ = textscan.words(pa.array([text]))
    monkeypatch.setattr(textscan, "PIECE", 64)
    assert (textscan.words(pa.array([text]))[0] == whole).all()
    assert len(textscan.words(pa.array(["y" * 1000]))[0]) == 1


def test_parts_cover_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "", "b" * 50, "c"])], ["t"])
    got = list(textscan.parts(batch, 0, 12))
    assert [x for p in got for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert len(got) > 1


# --- 1 sharding -------------------------------------------------------------------------------------------------------


def test_flow_is_cheapest():
    rng = random.Random(3)
    for _ in range(20):
        shards = rng.randint(1, 4)
        blocks = [sharding.Block(o, c, n := rng.randint(1, 6), n * 2**c) for o in range(rng.randint(1, 5)) for c in range(3)]
        moves = sharding.solve(blocks, shards)
        counts = Counter()
        for t in moves:
            counts[t.shard] += t.end - t.start
        sizes = [counts[s] for s in range(shards)]
        assert sum(sizes) == sum(b.rows for b in blocks) and max(sizes) - min(sizes) <= 1
        cost = sum((t.end - t.start) * 2**t.size_class for t in moves if t.shard != t.old)
        total, have = sum(b.rows for b in blocks), defaultdict(list)
        for b in blocks:
            have[b.old] += [2**b.size_class] * b.rows
        # at best, each surplus shard keeps its heaviest rows, and the rows that are one more are the dearest ones
        q, r, kept, spare = total // shards, total % shards, 0, []
        for o, v in have.items():
            v.sort(reverse=True)
            kept += sum(v[:q]) if o < shards else 0
            spare += v[q : q + 1] if o < shards else []
        kept += sum(sorted(spare, reverse=True)[:r])
        assert cost == sum(map(sum, have.values())) - kept


def test_shards_are_even_gapless_and_rewritten(spark, tmp_path):
    rows = corpus(2)
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", shard int").repartition(5).write.parquet(path)
    placed = sharding.reshard(spark, path, 4).persist()
    got = placed.collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len((t or "").encode()) + 1) for i, t in rows)
    written = sharding.rewrite(spark, path, placed, 4, str(tmp_path / "new"))
    back = spark.read.parquet(written.folder)
    assert back.columns == ["doc_id", "text", "shard", "slot", "shard_"] and set(written.affected) == {r.shard_ for r in back.select("shard_").distinct().collect()}
    now = written.rows(spark, "doc_id", "text").collect()
    assert Counter((r.doc_id, r.text) for r in now) == Counter(rows)
    assert Counter((str(r.doc_id), r.shard, r.slot) for r in now) == Counter((str(r.doc_id), r.shard, r.slot) for r in got)


def test_smallest_rows_move_and_even_shards_stay(spark, tmp_path):
    rng = random.Random(5)
    files = {0: 30, 1: 10, 2: 20, 3: 20}  # of the 80 rows each of four shards takes 20
    for k, n in files.items():
        spark.createDataFrame([(1000 * k + i, "x" * rng.randint(100, 140)) for i in range(n)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        next((tmp_path / f"part{k}").glob("*.parquet")).rename(tmp_path / f"{k}.parquet")
    path = str(tmp_path / "*.parquet")
    placed = sharding.reshard(spark, path, 4).persist()
    got = placed.collect()
    leaving = sorted(r["size"] for r in got if r.old == 0)[:10]
    assert sorted(r["size"] for r in got if r.shard != r.old) == leaving and {(r.old, r.shard) for r in got if r.shard != r.old} == {(0, 1)}
    written = sharding.rewrite(spark, path, placed, 4, str(tmp_path / "new"))
    assert written.affected == [0, 1]
    now = written.rows(spark, "doc_id").collect()
    assert Counter(r.shard for r in now) == dict.fromkeys(range(4), 20) and len({(r.shard, r.slot) for r in now}) == 80


def test_files_beyond_the_new_shards_are_one_node(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 2)
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(i, "same" if i % 3 else "x" * i) for i in range(90)], SCHEMA).repartition(30).write.parquet(path)
    seen, solve = [], sharding.solve
    monkeypatch.setattr(sharding, "solve", lambda blocks, shards: seen.extend(blocks) or solve(blocks, shards))
    got = sharding.reshard(spark, path, 4).collect()
    assert {b.old for b in seen} == {0, 1, 2, 3, 4} and sorted(r.doc_id for r in got) == list(range(90))
    assert sorted(Counter(r.shard for r in got).values()) == [22, 22, 23, 23] and len({(r.shard, r.slot) for r in got}) == 90


def test_sharding_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "e"))
    placed = sharding.reshard(spark, str(tmp_path / "e"), 16)
    assert placed.count() == 0
    assert sharding.rewrite(spark, str(tmp_path / "e"), placed, 16).rows(spark, "doc_id").count() == 0


# --- 2 line dedup -----------------------------------------------------------------------------------------------------


def lines_brute(rows, least):
    key = lambda line: line.strip(b"\x20\x09\x0a\x0b\x0c\x0d").lower()
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").encode().split(b"\n")} if k)
    out = Counter()
    for i, t in rows:
        lines = (t or "").encode().split(b"\n")
        keep = [x for x in lines if not (key(x) and seen[key(x)] >= least)]
        out[i, len(lines), len(lines) - len(keep), b"\n".join(keep)] += 1
    return out


LINED = [(i, "\n".join(["Same Line", f"own {i}", " same line\t", "", "ÄB" if i % 2 else "äb", "common" if i < 4 else "x"])) for i in range(12)] + ODD


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_line_dedup_matches_brute_force_by_filters_and_by_join(spark, limit):
    docs = frame(spark, LINED)
    got = line_dedup.LineIndex.build(docs, 4).apply(docs, broadcast_bytes=limit)
    assert Counter((i, n, d, t.encode()) for i, t, n, d in rows_of(got)) == lines_brute(LINED, 4)


def test_chunks_ask_the_shards_filters(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK_ROWS", 4)
    monkeypatch.setattr(line_dedup, "ASKED_BYTES", 64)
    rows = [*LINED, (50, "Same Line\n" * 500 + "end")]
    docs = frame(spark, rows).withColumns({"chunk": F.lit("x"), "key": F.lit(1)})
    got = line_dedup.LineIndex.build(docs, 4, shards=3).apply(docs, broadcast_bytes=0)
    assert got.columns == ["doc_id", "text", "chunk", "key", "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text.encode()) for r in got.collect()) == lines_brute(rows, 4)
    monkeypatch.setattr(line_dedup.CuckooFilter, "contains", lambda self, digests: np.ones(len(digests), bool))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text.encode()) for r in got.collect()) == lines_brute(rows, 4)


def test_line_index_is_reversible(spark):
    base, more = frame(spark, LINED[:7]), frame(spark, LINED[7:])
    first = line_dedup.LineIndex.build(base, 4)
    grown = first.insert(more)
    assert Counter(rows_of(grown.apply(frame(spark, LINED)))) == Counter(rows_of(line_dedup.LineIndex.build(frame(spark, LINED), 4).apply(frame(spark, LINED))))
    back = grown.delete(more)
    assert sorted((bytes(k), n) for k, n in rows_of(back.counts)) == sorted((bytes(k), n) for k, n in rows_of(first.counts))
    assert Counter(rows_of(back.apply(base))) == Counter(rows_of(first.apply(base)))


def test_cuckoo_filter():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(3000)]
    f = line_dedup.CuckooFilter.build(keys[:2000])
    assert f.contains(keys[:2000]).all() and f.contains(keys[2000:]).sum() <= 1
    f.delete(keys[:1000])
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(keys[1000:2000]).all() and f.contains(keys[:1000]).sum() <= 1 and f.n == 1000
    assert not line_dedup.CuckooFilter(4).insert(keys[:100])


def test_wrongly_accepted_keys_are_exceptions(spark, monkeypatch):
    monkeypatch.setattr(line_dedup.CuckooFilter, "contains", lambda self, digests: np.ones(len(digests), bool))
    docs = frame(spark, LINED)
    index = line_dedup.LineIndex.build(docs, 4)
    assert index.filters.count() > 0


def test_clashing_columns_give_way(spark):
    rows = spark.createDataFrame([(1, "a\nb", 9, 0.5)], SCHEMA + ", n_lines int, score double")
    assert rows_of(line_dedup.drop_repeated_lines(rows, 1)) == [(1, "", 0.5, 2, 2)]
    model = toxicity.fit(rows, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert rows_of(toxicity.score(rows, model)) == [(1, "a\nb", 9, 0.0)]


def test_line_dedup_of_nothing(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


# --- 3 decontamination ------------------------------------------------------------------------------------------------

ITEMS = [
    (1, "A farmer named Alice walks 12 km to the market and then carries 5 kg of apples back home before noon every day."),
    (2, "The quick question: which metal melts first when the oven reaches its highest setting, tin or lead or zinc?"),
    (3, "tiny item words"),
    (None, "an item without an id must not be looked for in any document at all"),
    (5, None),
    (6, ""),
]


def clean_words(n):
    rng = random.Random(n)
    return " ".join(rng.choice(WORDS) for _ in range(n))


LEAKS = [
    (1, clean_words(30) + " " + ITEMS[0][1] + " " + clean_words(30)),
    (2, "intro. A farmer named Robert walks 37 km to the market and then carries 9 kg of apples back home before noon every day. end"),
    (3, "A farmer named Robert walks 37 km to the market and then carries 37 kg of apples back home before noon every day."),
    (4, ITEMS[1][1].upper()),
    (5, clean_words(100)),
    (6, "The quick question: which metal melts first when we look at something else entirely in this sentence?"),
    (7, "here TINY item, words there"),
    *ODD,
]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decontamination(spark, limit):
    got = decontamination.contaminated(frame(spark, LEAKS), frame(spark, ITEMS, "item_id bigint, text string"), broadcast_bytes=limit)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (4, 2), (7, 3)}
    kinds = {(r.doc_id, r.item_id): r.kind for r in got.collect()}
    assert kinds[1, 1] == "words" and kinds[2, 1] == kinds[3, 1] == "template"  # document 3 merges two of the item's values into one


def test_decontamination_finds_what_brute_force_finds(spark):
    rng = random.Random(9)
    items = [(i, clean_words(20 + i)) for i in range(8)]
    docs = []
    for i in range(40):
        text = clean_words(200 + i)
        docs.append((i, text + (" " + rng.choice(items)[1] if i % 3 == 0 else "") + " " + clean_words(i)))
    tokens = lambda t: re.findall(r"[^\W\d_]+", t.lower())

    def share(item, doc):
        a, b, n = tokens(item), tokens(doc), decontamination.WINDOW
        there = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
        return sum(tuple(a[k : k + n]) in there for k in range(len(a) - n + 1)) / (len(a) - n + 1)

    want = {(d, i) for d, t in docs for i, x in items if share(x, t) >= 0.5}
    got = decontamination.contaminated(frame(spark, docs), frame(spark, items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and want


def found_in(spark, item, *texts):
    got = decontamination.contaminated(frame(spark, list(enumerate(texts))), frame(spark, [(1, item)], "item_id bigint, text string"))
    return {r.doc_id: r for r in got.collect()}


def test_literal_and_template_windows_count_together(spark):
    item = "Sara walks 3 km to school every day and on the way she always meets her two best friends. Sara then runs 4 km back to the house of her uncle Bob where 5 dogs wait."
    other = "Lena walks 6 km to school every day and on the way she always meets her two best friends. Lena then runs 8 km back to the house of her uncle Max where 9 dogs wait."
    got = found_in(spark, item, other, clean_words(60))
    assert set(got) == {0} and got[0].kind == "template" and got[0].cover == pytest.approx(20 / 29)  # 8 places by words, 12 more by template


def test_questions_dense_in_numbers_are_found(spark):
    mix = ("Mix 2 kg flour, 3 kg sugar, 5 kg butter, 7 kg salt and 11 kg rice.", "Mix 4 kg flour, 6 kg sugar, 8 kg butter, 1 kg salt and 9 kg rice.")
    add = ("Add 12 kg, 7 kg, 5 kg, 9 kg, 31 kg and 8 kg together.", "Add 1 kg, 2 kg, 3 kg, 4 kg, 50 kg and 6 kg together.")
    table = " ".join(map(str, range(100, 160))) + " and 7 more numbers"
    for item, copy in (mix, add):
        got = found_in(spark, item, f"intro words. {copy} The end.", table)
        assert set(got) == {0} and got[0].kind == "template" and got[0].cover == 1


def test_copies_with_words_put_in_are_chained(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    put_in = " ".join([*words[:20], "four", "more", "words", "here", *words[20:]])
    left_out = " ".join([*words[:18], *words[23:]])
    turned = " ".join([*words[20:], *words[:20]])
    got = found_in(spark, " ".join(words), put_in, left_out, turned, f"{clean_words(50)} {put_in}")
    assert {d: r.cover for d, r in got.items()} == {0: pytest.approx(26 / 33), 1: pytest.approx(21 / 33), 3: pytest.approx(26 / 33)}


def test_items_that_repeat_their_template_are_found(spark):
    pens = lambda *n: ", ".join(f"{k} red pens" for k in n)
    got = found_in(spark, pens(3, 4, 5, 6, 7, 8), pens(13, 24, 35, 46, 57, 68), pens(9, 9, 9, 9, 9, 9), "so " + pens(*range(50, 61)))
    assert set(got) == {0, 1, 2} and got[0].cover == got[1].cover == 1


def test_one_value_of_an_item_becomes_one_value(spark):
    item = "Ann has 7 pens and Bob has 7 pens more so that both together now count 14 pens in all, says the teacher."
    same = item.replace("7", "20").replace("14", "40")
    merged = item.replace("14", "9").replace("7", "9")
    broken = "Ann has 3 pens and Bob has 5 pens more so that both together now count 8 pens in all, says the teacher."
    got = found_in(spark, item, same, merged, broken)
    assert got[0].cover == got[1].cover == 1 and (2 not in got or got[2].cover < 0.7)


def test_templates_are_found_as_brute_force_finds_them(spark):
    """Items with repeated phrases, few words and many slots, re-parameterised by maps that may merge values; and by no map at all."""
    rng = random.Random(21)
    values = [str(v) for v in range(2, 60)]

    def item():
        phrases = [[rng.choice(WORDS[:12]) for _ in range(rng.randint(1, 3))] for _ in range(3)]
        return [t for _ in range(rng.randint(4, 9)) for t in (*rng.choice(phrases), rng.choice(values[:12]), *(["km"] * rng.randint(0, 1)))]

    def other(tokens):
        to = {v: rng.choice(values) for v in values}
        return [to.get(t, t) for t in tokens]

    items = [x for x in (item() for _ in range(60)) if len(x) >= 10]
    docs, want = [], set()
    for i, x in enumerate(items):
        docs.append((i, f"{clean_words(30)} {' '.join(other(x))} {clean_words(30)}"))
        want.add((i, i))
        docs.append((1000 + i, clean_words(80)))

    def consistent(a, b):  # b somewhere holds a with one value for each of its values
        return any(len(m := {(x, y) for x, y in zip(a, b[k:]) if x in values}) == len(dict(m)) and all(x == y or x in values and y in values for x, y in zip(a, b[k:])) for k in range(len(b) - len(a) + 1))

    assert all(consistent(items[i], docs[2 * d][1].split()) for d, i in want)
    got = decontamination.contaminated(frame(spark, docs), frame(spark, [(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string"))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert len(found & want) >= 0.9 * len(want) and not any(d >= 1000 for d, _ in found)


def test_short_items_and_ids_of_any_type(spark):
    rows = [("a", "Yes."), ("b", "yes it is so"), (None, "blue whale"), ("c", "a blue whale swims"), ("d", ""), ("e", "five kg now")]
    items = frame(spark, [("x", "yes"), ("y", "Blue whale!"), ("z", "..."), ("w", "five kg now")], "item_id string, text string")
    got = decontamination.contaminated(frame(spark, rows, "doc_id string, text string").withColumn("hash", F.lit(1)), items)
    assert {(r.doc_id, r.item_id, r.cover) for r in got.collect()} == {("a", "x", 1.0), (None, "y", 1.0), ("e", "w", 1.0)}


def test_longest_chain_matches_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        hits = sorted({(rng.randrange(8), rng.randrange(8)) for _ in range(rng.randint(1, 20))})
        place, spot = (np.array(x) for x in zip(*hits, strict=True))
        chain = decontamination._chain(spot, place)
        longest = [1] * len(hits)
        for j, (p, q) in enumerate(hits):
            longest[j] += max((longest[i] for i, (a, b) in enumerate(hits[:j]) if a < p and b < q), default=0)
        assert len(chain) == max(longest) and (np.diff(place[chain]) > 0).all() and (np.diff(spot[chain]) > 0).all()


def test_decontamination_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    items = frame(spark, ITEMS, "item_id bigint, text string")
    assert decontamination.contaminated(empty, items).count() == 0
    assert decontamination.contaminated(frame(spark, LEAKS), items.limit(0)).count() == 0


# --- 4 language-model scores -----------------------------------------------------------------------------------------


def test_cross_entropy_difference_matches_brute_force(spark):
    rows = [(i, t) for i, t in corpus(4) if i is not None and i < 900]
    target = {i for i, _ in rows if i % 3 == 0}
    got = lm_scoring.cross_entropy_difference(frame(spark, rows), spark.createDataFrame([(i,) for i in target], "x bigint"), word_share=1e-3, pair_share=1e-3)
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    total = sum(len(split(t)) for _, t in rows)
    all_words = Counter(w for _, t in rows for w in split(t))
    vocabulary = {w for w, n in all_words.items() if n >= max(2, np.ceil(1e-3 * total))}
    word = lambda w: w if w in vocabulary else None
    uni, bi, hist = ([Counter(), Counter()] for _ in range(3))
    for i, t in rows:
        for m in {0, int(i in target)}:
            before = "<s>"
            for w in map(word, split(t)):
                uni[m][w] += 1
                bi[m][before, w] += 1
                hist[m][before] += 1
                before = w
    kept = {p for p, n in bi[0].items() if n >= max(2, np.ceil(1e-3 * total))}
    share = lambda m, p: max(bi[m][p] - 0.75, 0) / max(hist[m][p[0]], 1)
    left = [{h: 1 - sum(share(m, p) for p in kept if p[0] == h) if hist[m][h] else 1.0 for h in hist[0]} for m in (0, 1)]

    def loss(m, t):
        out, before = 0.0, "<s>"
        for w in map(word, split(t)):
            p = (uni[m][w] + 1) / (sum(uni[m].values()) + len(vocabulary) + 1) * left[m].get(before, 1.0) + (share(m, (before, w)) if (before, w) in kept else 0)
            out, before = out - np.log(p), w
        return out / max(len(split(t)), 1)

    for i, n, background, aim, score in rows_of(got):
        text = dict(rows)[i]
        assert n == len(split(text))
        assert (background, aim, score) == pytest.approx((loss(0, text), loss(1, text), loss(0, text) - loss(1, text)), abs=1e-4)


def test_pairs_seen_twice_count_beside_any_number_of_tokens(spark):
    rows = [(i, "filler words come here " * 2500) for i in range(1000)] + [(2000, "quark gluon"), (2001, "quark gluon")]
    got = lm_scoring.cross_entropy_difference(frame(spark, rows), spark.createDataFrame([(2000,), (2001,)], "x bigint"))
    scored = {r.doc_id: r for r in got.collect()}
    total = 10_000_004 + 6 + 1
    start = np.log((2 - 0.75) / 1002 + 2 * 0.75 / 1002 * 3 / total)
    after = np.log((2 - 0.75) / 2 + 0.75 / 2 * 3 / total)
    assert len(scored) == len(rows)
    assert scored[2000].background_loss == pytest.approx(-(start + after) / 2, abs=1e-4)


def test_slices_and_chunks_change_no_score(spark, monkeypatch):
    rows, target = corpus(7), spark.createDataFrame([(i,) for i in range(0, 60, 3)], "x bigint")
    found = []
    for chunk, bucket, held in ((1 << 21, 1_000_000, 1_500_000), (500, 300, 100)):
        for name, value in (("CHUNK", chunk), ("BUCKET", bucket), ("HELD", held)):
            monkeypatch.setattr(lm_scoring, name, value)
        got = lm_scoring.cross_entropy_difference(frame(spark, rows), target)
        found.append(sorted((str(r.doc_id), r.n_tokens, round(r.background_loss, 4), round(r.target_loss, 4)) for r in got.collect()))
    assert found[0] == found[1]


def test_scores_of_odd_rows_and_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint")
    got = lm_scoring.cross_entropy_difference(frame(spark, ODD), none)
    assert got.count() == len(ODD) and all(r.score == 0 for r in got.where("n_tokens = 0").collect())
    assert lm_scoring.cross_entropy_difference(spark.createDataFrame([], SCHEMA), none).count() == 0


# --- 5 exact dedup ----------------------------------------------------------------------------------------------------


def exact_brute(rows):
    squeeze = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[squeeze(t)].append(i)
    return Counter((i, min((x for x in groups[squeeze(t)] if x is not None), default=None), len(groups[squeeze(t)]), hashlib.sha256(squeeze(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_exact_groups_match_brute_force(docs, block):
    got = exact_dedup.exact_groups(docs, block=block).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == exact_brute(corpus())
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_names_depend_on_the_texts_alone(spark):
    rows = [(i, f"{i % 7} " * (i % 40) + "end" * (i % 3)) for i in range(120)]
    found = []
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for parts, adaptive in ((4, "true"), (7, "false"), (31, "true")):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            data = spark.createDataFrame(rows, SCHEMA).repartition(parts).select("doc_id", F.col("text").cast("binary").alias("data"))
            known, names = exact_dedup.identities(data, block=8)
            found.append(sorted((r.doc_id, r.level, r.name) for r in known.join(names, "row").collect()))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(found[0]) == 120 and found[0] == found[1] == found[2]


def test_names_survive_digests_that_collide(docs):
    data = docs.select("doc_id", F.encode(exact_dedup.squeezed(F.col("text")), "utf-8").alias("data"))
    known, found = exact_dedup.identities(data, 16, digest=lambda b: F.unhex(F.substring(F.md5(b), 1, 2)))
    got = known.join(found, "row").groupBy("text_sha256").agg(F.countDistinct("level", "name").alias("n")).collect()
    assert all(r.n == 1 for r in got)
    assert found.select("level", "name").distinct().count() == len(got)


def test_exact_groups_of_nothing(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0


# --- 6, 9, 10 tokens --------------------------------------------------------------------------------------------------

SPECIAL = [(1000, "a <|endoftext|>  b<|endoftext|>"), (1001, "<|endoftext|>"), (1002, "tail  \n\n \t x' 'sé'LL don't 12³½ _a-b ㍿  y")]


@pytest.fixture(scope="module")
def ranks():
    import base64

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_rank_codec_equals_the_rank_library_and_round_trips(spark, name):
    import base64

    with open(public_tokenizers.path(name), "rb") as file:
        own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
    rows = corpus(5) + SPECIAL
    codec = bpe.Codec.from_ranks(public_tokenizers.path(name))
    got = bpe.decode(bpe.encode(frame(spark, rows), codec), codec).collect()
    assert Counter(bpe.round_trip(frame(spark, rows), codec).collect()) == Counter(got)
    want = Counter((i, " ".join(map(str, library.encode_ordinary(t or ""))), (t or "").encode()) for i, t in rows)
    assert Counter((r.doc_id, r.ids_text, bytes(r.decoded)) for r in got) == want


def test_every_code_point_is_split_as_the_library_does(ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    worker = bpe.Worker(bpe.Codec.from_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 64):
        text = "".join(f"a {chr(c)}b{chr(c)}{chr(c)} 1{chr(c)}" for c in points[k : k + 64])
        assert np.frombuffer(worker.encode(text), worker.codec.dtype).tolist() == library.encode_ordinary(text)


def test_offsets_cover_split_characters(spark):
    codec = bpe.Codec.from_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    text = "né 👍🏽 日本"
    (row,) = bpe.encode(frame(spark, [(1, text)]), codec, offsets=True).collect()
    table = bpe.Worker(codec).byte_table()
    data, at = text.encode(), 0
    for i, a, b in zip(np.frombuffer(row.ids, codec.dtype).tolist(), row.starts, row.ends, strict=True):
        assert data[at : at + len(table[i])] == table[i]
        at += len(table[i])
        assert len(data[: at].decode(errors="ignore")) <= b <= len(data[:at].decode(errors="ignore")) + 1 and a < b
    assert row.ends[-1] == len(text) and row.starts[0] == 0
    assert bpe.encode(frame(spark, [(1, text)]), codec).select(bpe.unpack(F.col("ids"), codec).alias("x")).first().x == np.frombuffer(row.ids, codec.dtype).tolist()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("sample", [0, 50])
def test_token_counts_equal_the_library(spark, name, sample):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    else:
        tokenizer = Tokenizer.from_file(path)
        count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    rows = corpus(6) + SPECIAL
    got = token_counts.token_counts(frame(spark, rows), path, limit=20, sample_docs=sample).collect()
    want = Counter((i, len((t or "").encode()), n := count(t or ""), n > 20) for i, t in rows)
    assert Counter(tuple(r) for r in got) == want


def test_token_files_read_back_what_the_library_encodes(spark, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    codec = bpe.Codec.from_json(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus(7, 200) + SPECIAL
    files = token_files.write(frame(spark, rows), codec, 2, image_bytes=500, part_bytes=4000)
    assert files.dictionary.data and files.images.count() > 4
    got = files.documents().collect()
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x := ids(t)), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in rows)
    ordered, at = sorted(got, key=lambda r: r.start), 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    keys = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert keys == sorted(keys)
    names = files.export(str(tmp_path), 1)
    with open(names[0], "rb") as file:
        image = token_files.Image(file.read(), files.dictionary)
    assert len(image.ids(0)) == int(image.tokens_before[1])
    with pytest.raises(ValueError, match="dictionary"):
        with open(names[0], "rb") as file:
            token_files.Image(file.read(), token_files.Dictionary(b""))


def test_token_files_split_hot_ids_and_keep_their_type(spark):
    codec = bpe.Codec.from_json(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    rows = [("same", prose(rng, 30)) for _ in range(300)] + [(None, prose(rng, 20)) for _ in range(100)] + [("Ünï", None), ("b", "x " * 200_000)]
    found = []
    for parts in (2, 5):
        made = spark.createDataFrame(rows, "doc_id string, text string").repartition(parts).withColumns({"payload": F.lit(1), "part": F.lit(2)})
        files = token_files.write(made, codec, 2, image_bytes=3000, part_bytes=8000)
        assert files.images.select("part").distinct().count() > 3
        found.append(sorted(map(tuple, files.documents().collect()), key=lambda r: r[1]))
    assert found[0] == found[1] and [r[0] for r in found[0]] == [None] * 100 + ["b"] + ["same"] * 300 + ["Ünï"]
    with pytest.raises(TypeError):
        token_files.write(spark.createDataFrame([(1.5, "x")], "doc_id double, text string"), codec, 2)


def test_token_files_of_nothing(spark):
    codec = bpe.Codec.from_json(public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.write(spark.createDataFrame([], SCHEMA), codec, 2).documents().count() == 0
    few = token_files.write(frame(spark, [(1, None)]), codec, 2)
    assert not few.dictionary.data and [tuple(r)[:3] for r in few.documents().collect()] == [(1, 0, 1)]


# --- 7 toxicity --------------------------------------------------------------------------------------------------------


def toxic_corpus(n=600, seed=11):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(2, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grubble", "snarkoid", "Blightwort", "plonkfin"]) + rng.choice(["", "s", "en"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad) if rng.random() > 0.03 else int(not bad)))
    return docs, labels, {i for i, t in docs if re.search("grubble|snarkoid|Blightwort|plonkfin", t)}


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = toxic_corpus()
    given = frame(spark, labels + [(None, 1), (3, None)], "doc_id bigint, toxic int").where(toxicity.learnable())
    model = toxicity.fit(frame(spark, docs), given)
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, docs + ODD), model).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= 0.3) == (i in truth) for i in held)
    assert right / len(held) > 0.95
    assert 0 <= min(got.values()) and max(got.values()) <= 1 and got[901] < 0.3
    assert model.labels.correlation.shape[0] == model.labels.table.shape[0]


def test_toxicity_without_labels(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    one = frame(spark, [(903, 1)], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()} == {0.0}


def test_label_model_finds_accuracies_and_correlated_voters():
    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.3
    accuracy = [0.9, 0.8, 0.7]
    votes = np.stack([np.where((rng.random(4000) < a) == y, 1, -1) for a in accuracy], axis=1)
    votes = np.concatenate([votes, votes[:, 2:3]], axis=1)  # the last voter repeats the third
    start = np.where(votes[:, 0] == 1, 0.9, 0.1)  # as from given labels
    model = toxicity.fit_label_model(votes, start, np.ones(4000), 100)
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.85
    assert model.weight[3] < 0.7 < model.weight[0]


# --- 8 near dedup ------------------------------------------------------------------------------------------------------


def near_brute(rows, size, similarity):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                both = len(sets[a] & sets[b])
                if 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                    parent[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            r = root(k)
            least[r] = i if least[r] is None else min(least[r], i)
    return Counter((i, len(sets[k]), least[root(k)], i is None or least[root(k)] == i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("size", "similarity"), [(2, 80), (5, 80), (2, 60)])
def test_near_groups_match_brute_force(spark, size, similarity):
    rng = random.Random(size)
    rows = corpus(8)
    base = [rng.choice(WORDS) + str(k) for k in range(60)]
    for i in range(2000, 2060):  # copies of one text that are further from each other than from it
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(60)] = f"new{rng.random()}"
        rows.append((i, " ".join(words)))
    got = near_dedup.near_groups(frame(spark, rows), size, similarity)
    assert Counter(map(tuple, got.collect())) == near_brute(rows, size, similarity)


@pytest.mark.parametrize("region", [20_000, 3])
def test_open_regions_lose_no_link(spark, monkeypatch, region):
    monkeypatch.setattr(near_dedup, "REGION", region)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(21)
    words = [f"w{k}" for k in range(50)]
    rows = []
    for i in range(40):  # a chain: each text is near the one before, the ends are far apart
        words[rng.randrange(50)] = f"n{i}"
        rows.append((i, " ".join(words)))
    got = near_dedup.near_groups(frame(spark, rows), 2, 80)
    assert Counter(map(tuple, got.collect())) == near_brute(rows, 2, 80)


def test_minhash_agrees_as_often_as_sets_are_similar():
    rng = np.random.default_rng(2)
    for n in (3, 40, 500):
        same = []
        for _ in range(60):
            shared, own = textscan.mix(rng.integers(1, 2**62, n).astype(np.uint64)), textscan.mix(rng.integers(1, 2**62, 2 * max(1, n // 8)).astype(np.uint64))
            half = len(own) // 2
            a, b = np.unique(np.concatenate([shared, own[:half]])), np.unique(np.concatenate([shared, own[half:]]))
            same.append((near_dedup.minhash(a) == near_dedup.minhash(b)).mean() - n / (n + len(own)))
        assert abs(np.mean(same)) < 0.05


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = dict(rows_of(components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_groups_of_nothing(spark):
    assert near_dedup.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0
