"""Every operator on empty tables, nulls, repeated rows, very long texts and extra columns with clashing names; and brute force where SQL has no form."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tilewright.llm import additive_quality, bpe, chat_format, compact_windows, hyperlang, lp_packing, minhash_forest, ogg_media, queries, repair_tokens, scratch, simhash_windows, url_rules
from tilewright.llm import words as W

#: Names that operators use for columns of their own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key long, n long, comp long, sig binary, score double, length long, part int, rank long, h long, cuts int, shard binary, y int, x double, kind int"
CLASH = (None, None, 3, 7, 7, 7, 7, b"s", 0.5, 9, 1, 1, 1, 1, b"x", 1, 0.1, 2)
LONG = "lorem ipsum dolor sit amet consectetur " * 30_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *CLASH) for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, "same text twice over"), (7, "same text twice over"), (8, "rows"), (8, "rows"), (None, "no id"), (None, "no id"), (-9, "é😀日本 \x00 ünï")]


@pytest.fixture(scope="module")
def models(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~hyperlang.held_out())
    return hyperlang.fit_profiles(d.where(~hyperlang.held_out()).select("lang", "text")), additive_quality.fit_quality(d, labels)


def operators(models):
    lang, quality = models
    return {
        "near": lambda d: minhash_forest.near_duplicates(d, 2, 80),
        "language": lambda d: hyperlang.identify(d, lang, "score"),
        "quality": lambda d: additive_quality.score_quality(d, quality),
        "media": lambda d: ogg_media.read_media(ogg_media.to_media(d)),
        "tokens": lambda d: repair_tokens.token_files(d),
    }


@pytest.mark.parametrize("name", ["near", "language", "quality", "media", "tokens"])
def test_a_row_for_every_row(spark, models, name):
    op = operators(models)[name]
    got = op(docs(spark, ODD)).collect()
    assert Counter(x["doc_id"] for x in got) == Counter(i for i, _ in ODD)
    twins = [{k: v for k, v in x.asDict().items() if k not in ("start", "doc_id", "component_id", "kept")} for x in got if x["doc_id"] == 8]
    assert twins[0] == twins[1]
    assert op(docs(spark, [])).count() == 0
    assert op(docs(spark, ODD)).columns == op(docs(spark, [])).columns


def test_passages_of_odd_rows(spark):
    got = compact_windows.repeated_passages(docs(spark, [*ODD, (20, LONG + "and an end"), (21, "x y z " + LONG), (8, "rows")])).collect()
    assert {x["doc_id"] for x in got} == {5, 20, 21} and {x["source_id"] for x in got} == {5}
    words = {5: len(LONG.split()), 20: len(LONG.split()) + 3, 21: len(LONG.split()) + 3}
    assert {d: sum(x["n_words"] for x in got if x["doc_id"] == d) for d in words} == {5: words[5], 20: words[5], 21: words[5]}
    assert compact_windows.repeated_passages(docs(spark, [])).count() == compact_windows.cut_passages(docs(spark, [])).count() == 0
    assert compact_windows.cut_passages(docs(spark, ODD)).count() == len(ODD)


def test_packing_of_odd_rows(spark):
    got = lp_packing.pack(docs(spark, ODD), capacity=512).collect()
    by = defaultdict(list)
    for x in got:
        by[x["sequence_id"]].append((x["offset"], x["length"]))
    for places in by.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1].tolist()] and ends[-1] <= 512
    assert Counter(x["doc_id"] for x in got if x["piece"] == 0) == Counter(i for i, _ in ODD)
    assert lp_packing.pack(docs(spark, [])).count() == 0


def test_shards_longer_than_their_limit_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(repair_tokens, "SHARD_TOKENS", 1000)
    rows = [(1, LONG[:60_000]), (1, LONG[:60_000]), (1, "b"), (None, "a"), (None, "a"), (0, "z")]
    tok = bpe.PieceEncoder(bpe.default_path()).tokenizer
    got = sorted(repair_tokens.token_files(docs(spark, rows)).collect(), key=lambda x: x["start"])
    assert [x["doc_id"] for x in got] == [None, None, 0, 1, 1, 1]
    sizes = {t: len(tok.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows}
    assert sorted(x["n_tokens"] for x in got) == sorted(sizes[t] for _, t in rows)
    assert [x["start"] for x in got] == np.cumsum([0, *(x["n_tokens"] for x in got[:-1])]).tolist()


def test_urls_long_and_repeated(spark):
    url = "http://sub.example.com/en/" + "a/" * 20_000 + "?q"
    df = spark.createDataFrame([(1, url, 1), (1, url, 1), (2, None, 1), (3, "http://" + "h" * 50_000, 1)], "page_id long, url string, row long")
    got = url_rules.judge(df).collect()
    assert Counter(x["page_id"] for x in got) == {1: 2, 2: 1, 3: 1}
    assert {x["rule"] for x in got if x["page_id"] == 1} == {"example.com/en/"} and url_rules.judge(df.where("false")).count() == 0


def test_a_very_long_conversation(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", "word <| \\ " * 200) for k in range(1000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    x = chat_format.chat_digests(chat_format.format_chats(df)).first()
    told = "".join(t for _, _, r, t in rows if r == "assistant")
    assert (x["n_turns"], x["loss_chars"], x["loss_sha256"]) == (1000, len(told), hashlib.sha256(told.encode()).hexdigest())


def test_media_columns_of_a_table(spark, sf):
    texts = {x["doc_id"]: (x["text"] or "").encode("utf-8", "replace") for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for x in queries.op7_media(spark, sf).collect():
        raw = texts[x["doc_id"]]
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_quality_of_held_out_rows(spark, sf):
    d = "/root/testdata/sf0.01" if sf.endswith("sf0.001") else sf
    labels = {x["doc_id"]: x["quality"] for x in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [(labels[x["doc_id"]], x["score"], x["predicted"]) for x in queries.op6_quality(spark, d).collect() if x["held_out"] and x["doc_id"] in labels]
    good, bad = np.array([s for y, s, _ in rows if y == 1]), np.array([s for y, s, _ in rows if y == 0])
    assert len(good) > 5 and len(bad) > 5
    assert ((good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()) > 0.95
    assert np.mean([y == p for y, _, p in rows]) > 0.9


def test_repeated_documents_and_labels_count_once(spark):
    rows = [(k, f"some text {k} " * (1 + k % 7)) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    once = additive_quality.fit_quality(docs(spark, rows), labels)
    again = additive_quality.fit_quality(docs(spark, rows + rows[:30]), labels.unionByName(labels))
    x = additive_quality.features([t for _, t in rows])
    assert np.allclose(once.score(x), again.score(x))


def test_leaks_by_brute_force(spark):
    """All windows of all documents against all items, by the stated weights."""
    r = random.Random(17)

    def words(n):
        return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(n)]

    common = words(12)
    items = {k: (common if k % 3 == 0 else []) + words(r.randint(12, 40)) for k in range(12)}
    items[12] = list(items[3])  # a repeated row counts once
    texts = {}
    for d in range(40):
        body, own = words(r.randint(0, 60)), list(items[r.randrange(12)])
        for _ in range(r.randint(0, 3)):
            own[r.randrange(len(own))] = words(1)[0]
        texts[d] = body + (own if d % 4 else own[: len(own) // 2]) + words(r.randint(0, 30))
    holders = Counter(s for t in {tuple(i) for i in items.values()} for s in {t[k : k + 5] for k in range(len(t) - 4)})

    def similarity(window, item):
        a, b = (Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4)) for x in (window, item))
        total = sum(n / holders[s] for s, n in b.items())
        mean = total / sum(b.values())
        shared = sum(min(n, b[s]) / holders[s] for s, n in a.items() if s in b)
        more = sum(max(0, n - b[s]) / holders[s] for s, n in a.items() if s in b)
        return shared / (total + more + mean * sum(n for s, n in a.items() if s not in b))

    want = {}
    for d, t in texts.items():
        for i, item in items.items():
            windows = [t[k : k + len(item)] for k in range(len(t) - len(item) + 1)] or [t]
            best = max(similarity(w, item) for w in windows)
            if best >= 0.8 - 1e-9:
                want[d, i] = round(best, 6)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    table = docs(spark, [(d, " ".join(t)) for d, t in texts.items()] + ODD)
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in simhash_windows.benchmark_leaks(table, bench).collect()}
    assert len(want) > 15 and set(got) <= set(want)
    assert len(got) >= 0.97 * len(want) and all(abs(want[k] - v) < 1e-5 for k, v in got.items())


def test_leaks_of_long_and_repeated_rows(spark):
    bench = spark.createDataFrame([(1, "a long item of many words that no one else would ever write down"), (1, "a long item of many words that no one else would ever write down")], "item_id long, text string")
    rows = [(1, LONG + "a long item of many words that no one else would ever write down"), (2, "x"), (3, "a long item of many words that no one else would ever write down"), (3, "a long item of many words that no one else would ever write down")]
    got = simhash_windows.benchmark_leaks(docs(spark, rows), bench).collect()
    assert Counter(x["doc_id"] for x in got) == {1: 2, 3: 4} and {x["similarity"] for x in got} == {1.0}


def test_scratch_tables_can_be_cleared(spark):
    s = scratch.Scratch(spark, "cleared")
    t = s.table("t", spark.range(3))
    assert t.count() == 3
    scratch._made[spark.sparkContext.applicationId] = [s.base]
    scratch.clear(spark)
    with pytest.raises(Exception, match="(?i)does not exist|not found|path"):
        spark.read.parquet(f"{s.base}/t").count()


def test_word_hashes_of_long_words_and_texts():
    h, at = W.hash_words(W.encoded(["x" * 1_000_000, LONG]))
    assert np.diff(at).tolist() == [1, len(LONG.split())] and len(set(h.tolist())) == 1 + len(set(LONG.split()))


def test_held_out_is_decided_by_the_id_alone(spark):
    got = spark.createDataFrame([(None,), (1,), (2,)], "doc_id long").select("doc_id", hyperlang.held_out().alias("h")).collect()
    assert [x["h"] for x in got] == [True, zlib.crc32(b"1") % 5 == 0, zlib.crc32(b"2") % 5 == 0]
