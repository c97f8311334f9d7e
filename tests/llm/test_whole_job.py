"""Cases in which an operator once did less than the whole job."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from tilewright.llm import compact_windows, simhash_windows
from tilewright.llm import words as W


def words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 7))) for _ in range(n)]


def table(spark, docs: dict[int, list[str]]):
    return spark.createDataFrame([(i, " ".join(w), None, None, 0) for i, w in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")


def brute_sources(docs: dict[int, list[str]], least: int = 50) -> dict[int, list[int]]:
    """Of each word the smallest document that has one of the passages of `least` words around it, itself included; -1: no other has any."""
    holders = defaultdict(set)
    for d, w in docs.items():
        for k in range(len(w) - least + 1):
            holders[tuple(w[k : k + least])].add(d)
    out = {d: [-1] * len(w) for d, w in docs.items()}
    for d, w in docs.items():
        for k in range(len(w) - least + 1):
            if len(own := holders[tuple(w[k : k + least])]) > 1:
                out[d][k : k + least] = [min(own) if x < 0 else min(x, *own) for x in out[d][k : k + least]]
    return out


def found_sources(spark, docs: dict[int, list[str]]) -> dict[int, list[int]]:
    out = {d: [-1] * len(w) for d, w in docs.items()}
    for x in compact_windows.repeated_passages(table(spark, docs)).collect():
        for k in range(x["start_word"], x["start_word"] + x["n_words"]):
            assert out[x["doc_id"]][k] == -1
            out[x["doc_id"]][k] = x["source_id"]
    return out


def overlapping(r: random.Random) -> dict[int, list[str]]:
    long, p, q, s = words(r, 460), words(r, 60), words(r, 55), words(r, 300)
    long[200:260] = p
    s[100:160] = p
    return {
        5: words(r, 30) + p + words(r, 30), 10: long + words(r, 20), 20: words(r, 25) + long + words(r, 25),  # a long stretch that holds an earlier passage
        30: q + words(r, 40), 31: p + q + words(r, 40),  # two passages that touch
        40: s, 41: list(s),  # copies that hold an earlier passage
    }


def test_sources_of_overlapping_passages_by_brute_force(spark):
    docs = overlapping(random.Random(31))
    want = brute_sources(docs)
    assert set(want[10][:200] + want[10][260:460]) == {10} and set(want[10][200:260]) == {5}
    got = found_sources(spark, docs)
    assert all(got[d] == want[d] for d in docs if d not in (20, 41))
    kept = {d: [x if x in (-1, d) else "cut" for x in w] for d, w in got.items()}
    assert kept == {d: [x if x in (-1, d) else "cut" for x in w] for d, w in want.items()}


def test_only_words_of_an_earlier_document_are_cut(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = overlapping(random.Random(32))
    del docs[41]
    source = brute_sources(docs)
    want = {d: [x for x, s in zip(w, source[d]) if s in (-1, d)] for d, w in docs.items()}
    got = {x["doc_id"]: x["text"].split() for x in pipeline.substring_dedup(spark, table(spark, docs), "").collect()}
    assert got == {d: w for d, w in want.items() if w}


def test_smallest_sources_by_brute_force():
    r = random.Random(3)
    for _ in range(200):
        spans = [(a := r.randrange(40), a + r.randint(1, 15), r.randrange(6)) for _ in range(r.randint(1, 12))]
        word = [min((s for a, b, s in spans if a <= k < b), default=None) for k in range(60)]
        got = compact_windows.smallest_sources(spans)
        back = [None] * 60
        for a, b, s in got:
            back[a:b] = [s] * (b - a)
        assert back == word and all(x[1] < y[0] or (x[1] == y[0] and x[2] != y[2]) for x, y in zip(got, got[1:]))


def test_pairs_in_covered_places_are_compared(spark):
    """Whose b place is covered, but from a later source; whose places are covered, but not to the passage's end."""
    r = random.Random(33)
    near = words(r, 5)
    x, y, p = words(r, 60), words(r, 52), words(r, 75)
    b = words(r, 40) + x + near + y + words(r, 40)
    docs = {
        1: words(r, 30) + x + words(r, 30), 2: words(r, 30) + y + words(r, 30), 3: b,
        4: words(r, 35) + b[80:180] + words(r, 35), 5: words(r, 35) + y + words(r, 35),
        11: words(r, 30) + p[:60] + words(r, 30), 12: words(r, 30) + p + words(r, 30), 13: words(r, 35) + p + words(r, 35),
    }
    assert found_sources(spark, docs) == brute_sources(docs)


def test_runs_of_repeated_words(spark):
    """A run of one word and a cycle of three, longer than any one comparison sees."""
    r = random.Random(34)
    docs = {1: words(r, 30) + ["same"] * 400 + words(r, 30), 2: words(r, 60) + ["same"] * 400 + words(r, 10), 3: words(r, 20) + ["x", "y", "z"] * 150, 4: ["x", "y", "z"] * 150 + words(r, 90), 5: ["same"] * 90 + words(r, 9)}
    assert found_sources(spark, docs) == brute_sources(docs)


def test_a_passage_in_many_documents(spark):
    """Some of the holders also share a word beside the passage, by chance."""
    r = random.Random(12)
    passage = words(r, 60)
    beside = [["ab"], ["cd"], []]
    docs = {i: words(r, 30) + passage + beside[i % 3] + words(r, 30) for i in range(200)}
    got = found_sources(spark, docs)
    assert got == brute_sources(docs) and all(x == 0 for w in got.values() for x in w[30:90])


def test_a_phrase_in_many_documents_hides_no_passage(spark):
    """Two of many holders of a phrase of 40 words share 15 more: they must meet, though the phrase's first holder shares less."""
    r = random.Random(35)
    phrase, more = words(r, 40), words(r, 15)
    docs = {k: words(r, 30) + phrase + words(r, 30) for k in range(300)}
    docs[150], docs[250] = words(r, 22) + phrase + more + words(r, 9), words(r, 40) + phrase + more + words(r, 31)
    assert found_sources(spark, docs) == brute_sources(docs)


def test_no_passage_of_a_table_is_missed(spark, sf):
    rows = [x for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if x["text"]]
    docs = {x["doc_id"]: x["text"].encode().lower().split() for x in rows}
    copies = defaultdict(list)
    for d, w in docs.items():
        copies[tuple(w)].append(d)
    want = brute_sources(docs)
    got = {d: [-1] * len(w) for d, w in docs.items()}
    for x in compact_windows.repeated_passages(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        got[x["doc_id"]][x["start_word"] : x["start_word"] + x["n_words"]] = [x["source_id"]] * x["n_words"]
    for d, w in docs.items():
        assert all(g >= 0 for g, x in zip(got[d], want[d]) if x >= 0)
        if d == min(copies[tuple(w)]):
            assert all(g <= x for g, x in zip(got[d], want[d]) if x >= 0)


def test_most_edited_passages_are_found(spark):
    """Passages of 60 to 120 words with a similarity just over 0.8."""
    r = random.Random(36)
    docs, edits = {}, {}
    for k in range(150):
        n = r.randint(60, 120)
        p = words(r, n)
        q = list(p)
        for e in range(1 + n // 100):
            at = 25 + 45 * e + r.randint(0, 9)
            q[at] = "edit"
        s, t = ({tuple(x[i : i + 5]) for i in range(n - 4)} for x in (p, q))
        assert len(s & t) >= 0.8 * len(s | t)
        docs[2 * k], docs[2 * k + 1] = words(r, 40) + p + words(r, 40), words(r, 30) + q + words(r, 50)
        edits[2 * k + 1] = 30 + at
    got = found_sources(spark, docs)
    assert sum(got[d][at] == d - 1 for d, at in edits.items()) >= 0.9 * len(edits)
    assert all(got[d][0] == got[d][-1] == -1 for d in docs)


def test_one_id_with_different_texts_is_left_alone(spark):
    r = random.Random(37)
    a, b = words(r, 80), words(r, 70)
    df = spark.createDataFrame([(1, " ".join(a), "k"), (1, " ".join(b), "k"), (2, " ".join(a + words(r, 9)), "k"), (3, " ".join(a), "k"), (3, " ".join(a), "k"), (None, " ".join(a), "k"), (4, None, "k")], "doc_id long, text string, cuts string")
    got = compact_windows.repeated_passages(df).collect()
    assert {(x["doc_id"], x["source_id"]) for x in got} == {(2, 2), (3, 2)}
    left = compact_windows.cut_passages(df)
    assert left.columns == df.columns and sorted((x["doc_id"] or 0) for x in left.collect()) == [0, 1, 1, 2, 4]


def test_rows_are_decontaminated_by_their_own_text(spark):
    r = random.Random(44)
    item = words(r, 40)
    df = spark.createDataFrame([(None, " ".join(item), 1.0), (1, " ".join(words(r, 40)), 2.0), (1, " ".join(words(r, 9) + item), 3.0), (2, None, 4.0), (None, "x", 5.0)], "doc_id long, text string, similarity double")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert sorted(x["similarity"] for x in simhash_windows.without_leaks(df, bench).collect()) == [2.0, 4.0, 5.0]
    assert simhash_windows.without_leaks(df, bench.where("false")).count() == 5


def leaks(spark, docs: dict[int, list[str]], items: list[tuple[int, list[str]]]) -> dict:
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    return {(x["doc_id"], x["item_id"]): x["similarity"] for x in simhash_windows.benchmark_leaks(table(spark, docs), bench).collect()}


def test_edited_copies_of_repeated_items_leak(spark, monkeypatch):
    r = random.Random(41)
    item = words(r, 60)
    copies = [(k, [*item[:59], f"end{k // 5}"]) for k in range(10)]  # two texts, five times each
    doc = words(r, 20) + [*item[:30], "changed", *item[31:59], "end0"] + words(r, 20)
    got = leaks(spark, {1: doc, 2: words(r, 100)}, copies)
    assert {(1, k) for k in range(5)} <= set(got) and {d for d, _ in got} == {1}
    monkeypatch.setattr(simhash_windows, "BLOCK_ITEMS", 3)
    assert leaks(spark, {1: doc, 2: words(r, 100)}, copies) == got


def test_documents_shorter_than_the_item_leak(spark):
    r = random.Random(42)
    item, other = words(r, 60), words(r, 40)
    docs = {1: item[:-1], 2: item[1:], 3: item[5:-5], 4: item[:30], 5: item + words(r, 9)}
    got = leaks(spark, docs, [(1, item), (2, other)])
    assert {d for d, _ in got} == {1, 2, 3, 5} and abs(got[1, 1] - 55 / 56) < 1e-6


def test_radius_covers_unknown_words_at_an_end():
    r = random.Random(43)
    items = [(k, W.hash_words([" ".join(words(r, 40)).encode()])[0]) for k in range(200)]
    block = simhash_windows._Block(items, 80, simhash_windows.RADIUS)
    new = np.random.default_rng(43)
    for i, w in items:
        for edited in (1, 2, 3):
            v = w.copy()
            v[-edited:] = new.integers(0, 1 << 63, edited, dtype=np.uint64)
            assert block.similarity(W.shingle(v, simhash_windows.SHINGLE), i) >= 0.8
            _, found = block.candidates(block.fingerprints(block.running(v), np.zeros(1, np.int64), 40), 40)
            assert i in found.tolist()
