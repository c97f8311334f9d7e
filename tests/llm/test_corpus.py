"""The corpus operators against brute force, on small fixtures with awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.llm import bpe, compact_windows, components, hyperlang, lp_packing, minhash_forest, ogg_media, queries, repair_tokens, simhash_windows, url_rules
from tilewright.llm import additive_quality as quality
from tilewright.llm import chat_format as chat
from tilewright.llm import words as W
from tilewright.llm.components import connected_components
from tilewright.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, score double"


def words(r: random.Random, n: int, letters: str = "abcdefghij") -> list[str]:
    return ["".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(n)]


def table(spark, texts: list[tuple[int | None, str | None]], lang: str | None = None):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, None, len(t or ""), "k", 7, 0.5) for i, t in texts], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_twin(name, spark, duck, same, sf):
    same(queries.QUERIES[name](spark, sf), duck, queries.ORACLE[name])


def plain_words(t: str | None) -> list[bytes]:
    return (t or "").encode().lower().split()


def test_word_hashes():
    texts = ["A b\tA", None, "", " \n ", "é É a", "x" * 100_000 + " y"]
    h, at = W.hash_words(W.encoded(texts))
    assert np.diff(at).tolist() == [3, 0, 0, 0, 3, 2]
    flat = [w for t in texts for w in plain_words(t)]
    assert len(set(h.tolist())) == len(set(flat)) and len({(a, b) for a, b in zip(flat, h.tolist())}) == len(set(flat))
    whole = W.shingle(h[at[0] : at[1]], 5)
    assert len(whole) == 1 and (W.shingle_all(h, 3)[:1] == W.shingle(h[:3], 3)).all()


def brute_components(texts: dict[int, str | None], n: int, percent: int) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = plain_words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))} if w else set()
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_duplicates(spark):
    r = random.Random(5)
    texts: dict[int, str | None] = {}
    for g in range(12):
        base = words(r, 60)
        for _ in range(r.choice([1, 2, 5])):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 4])):
                w[r.randrange(len(w))] = "".join(words(r, 1))
            texts[len(texts)] = " ".join(w).upper() if r.random() < 0.3 else "\n".join(w)
    hub = words(r, 80)  # a large group of near copies
    for k in range(60):
        w = list(hub)
        w[k] = "zz"
        texts[len(texts)] = " ".join(w)
    for t in (None, "", "   ", "one", "ONE", "two words", "x " * 3000):
        texts[len(texts)] = t
    docs = table(spark, list(texts.items()))
    rows = {x["doc_id"]: x for x in minhash_forest.near_duplicates(docs, 2, 80).collect()}
    want = brute_components(texts, 2, 80)
    assert {i: x["component_id"] for i, x in rows.items()} == want
    assert all(x["kept"] == (x["component_id"] == i) for i, x in rows.items())
    assert [rows[len(texts) - k]["n_shingles"] for k in (7, 6, 5, 4, 1)] == [0, 0, 0, 1, 1]


def test_near_duplicates_in_a_crowd_by_brute_force(spark):
    """Hundreds of pages of a template, a little less alike than the threshold, with some pairs above it."""
    r = random.Random(6)
    template = words(r, 175, "abcdefghijklmnop")
    pages = {i: template + words(r, 27, "abcdefghijklmnop") for i in range(500)}
    for k in range(40):
        pages[500 + k] = template + pages[r.randrange(500)][175 : 175 + r.randint(4, 9)] + words(r, 20, "abcdefghijklmnop")
    texts = {i: " ".join(w) for i, w in pages.items()}
    want = brute_components(texts, 2, 80)
    assert 10 < sum(c != i for i, c in want.items()) < 60
    got = {x["doc_id"]: x["component_id"] for x in minhash_forest.near_duplicates(table(spark, list(texts.items())), 2, 80).collect()}
    assert got == want


@pytest.mark.parametrize("percent, crowd", [(80, 4), (80, 512), (40, 2)])
def test_no_crowd_is_left_out(spark, monkeypatch, percent, crowd):
    """Sets of a few blocks, so that many share each of their rarest shingles."""
    monkeypatch.setattr(minhash_forest, "CROWD", crowd)
    r = random.Random(31)
    universe = np.random.default_rng(4).integers(-(1 << 62), 1 << 62, 40)
    sets = {i: sorted({int(universe[k]) for k in (range(25 * (i % 3 > 0)), r.sample(range(25, 40), r.randint(1, 12))) for k in k}) for i in range(90)}
    comp = {i: i if i % 5 else 0 for i in sets}
    dense = spark.createDataFrame([(i, comp[i], s) for i, s in sets.items()], "id long, comp long, shingles array<long>")
    want = {(a, b) for a in sets for b in sets if a < b and comp[a] != comp[b] and sets[a] != sets[b] and 100 * len({*sets[a]} & {*sets[b]}) >= percent * len({*sets[a]} | {*sets[b]})}
    space = Scratch(spark, "crowd")
    got = {(x["a"], x["b"]) for x in minhash_forest.dense_pairs(dense, percent, space).collect()}
    assert len(want) > 100 and want <= got


def test_a_crowd_makes_few_pairs(spark):
    """A template's pages, of which most are one component: only pairs that may be alike enough become rows."""
    r = random.Random(12)
    universe = np.random.default_rng(9).integers(-(1 << 62), 1 << 62, 4000).tolist()
    template, other = universe[:150], universe[150:]
    sets = {i: sorted({*r.sample(template, 144)} if i % 6 else {*r.sample(template, 120), *r.sample(other, 12)}) for i in range(900)}
    sets[900] = sorted({*sets[6][:-3], *other[3000:3003]})
    comp = {i: i if i % 6 == 0 else 1 for i in sets}
    dense = spark.createDataFrame([(i, comp[i], s) for i, s in sets.items()], "id long, comp long, shingles array<long>")
    own = {i: {*s} for i, s in sets.items()}
    want = {(a, b) for a in own for b in own if a < b and comp[a] != comp[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])}
    got = [(x["a"], x["b"]) for x in minhash_forest.dense_pairs(dense, 80, Scratch(spark, "few")).collect()]
    assert (6, 900) in want and want <= set(got)
    assert len(got) == len(set(got)) < 3000  # of about 120,000


def test_parities_differ_in_no_more_bits_than_sets():
    r = random.Random(3)
    universe = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 3000).tolist()
    for n in (1, 5, 100, 127, 128, 129, 300, 2600):
        a = r.sample(universe, n)
        b = [*a[n // 10 :], *r.sample(universe, n // 12)]
        x, y = (np.frombuffer(minhash_forest.parities(np.array(sorted({*s}), np.int64)), np.uint64)[None] for s in (a, b))
        words = min(x.shape[1], y.shape[1])
        apart = int(np.bitwise_count(minhash_forest._folded(x, words) ^ minhash_forest._folded(y, words)).sum())
        assert apart <= len({*a} ^ {*b}) and apart % 2 == len({*a} ^ {*b}) % 2


def test_alike_sets_share_one_of_their_rarest():
    r = random.Random(8)
    for _ in range(300):
        n, m = r.randint(1, 40), r.randint(1, 40)
        few, most = min(minhash_forest.rarest(min(n, m), 80)[0], min(n, m)), minhash_forest.rarest(max(n, m), 80)[1]
        # the larger and the smaller share all but their rarest, as badly as can be
        common = -(-80 * (n + m) // 180)
        if common <= min(n, m):
            assert few + common > min(n, m) and most + common > max(n, m)


def test_near_duplicates_of_nothing_and_repeats(spark):
    assert minhash_forest.near_duplicates(table(spark, []), 5).count() == 0
    got = minhash_forest.near_duplicates(table(spark, [(3, "a b c"), (3, "a b c"), (None, "a b c"), (5, "A b C")]), 2).collect()
    assert sorted((x["doc_id"] or 0, x["component_id"] or 0, x["kept"]) for x in got) == [(0, 0, True), (3, 3, True), (3, 3, True), (5, 3, False)]


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99), (99, 100), (7, 7), (200, 201)], "a long, b long")
    got = {x["node"]: x["component"] for x in connected_components(edges, Scratch(spark, "t"), "cc").collect()}
    assert got == {**{k: 0 for k in range(41)}, 99: 99, 100: 99, 200: 200, 201: 200}


@pytest.mark.parametrize("one_task", [0, 1 << 19])
def test_components_by_brute_force(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    r = random.Random(one_task)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)]
    want = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in want:
        for a, b in pairs:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    edges = spark.createDataFrame([*pairs, (None, 3), (4, None)], "a long, b long")
    got = connected_components(edges, Scratch(spark, "t"), "cc").collect()
    assert len(got) == len(want) and {x["node"]: x["component"] for x in got} == want


def test_few_edges_take_few_jobs(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    sc = spark.sparkContext
    sc.setJobGroup("few-edges", "")
    try:
        assert connected_components(edges, Scratch(spark, "t"), "cc").count() == 41
        assert len(sc.statusTracker().getJobIdsForGroup("few-edges")) < 8
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_benchmark_leaks(spark):
    r = random.Random(9)
    items = [(k, " ".join(words(r, r.randint(15, 60)))) for k in range(30)]
    long_item = words(r, 60)
    edited = list(long_item)
    edited[40] = "changed"
    docs = [(0, " ".join(words(r, 300))), (1, f"{' '.join(words(r, 50))}\n{items[3][1].upper()}\t{' '.join(words(r, 50))}"), (2, items[7][1]), (3, " ".join(words(r, 20) + edited + words(r, 20))),
            (4, " ".join(items[5][1].split()[:8])), (5, None), (6, ""), (7, f"{items[1][1]} {items[2][1]}"), (8, items[7][1])]
    bench = spark.createDataFrame([*items, (90, " ".join(long_item)), (91, None), (None, "x y z u v w"), (92, "a b")], "item_id long, text string")
    got = simhash_windows.benchmark_leaks(table(spark, docs), bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == {(1, 3), (2, 7), (3, 90), (7, 1), (7, 2), (8, 7)}
    first = next(x for x in got if x["doc_id"] == 1)
    assert (first["start_word"], first["similarity"]) == (50, 1.0)
    assert simhash_windows.benchmark_leaks(table(spark, []), bench).count() == simhash_windows.benchmark_leaks(table(spark, docs), bench.where("false")).count() == 0


def test_index_finds_all_fingerprints_within_the_radius():
    r = random.Random(2)
    items = [(k, W.hash_words([" ".join(words(r, 20)).encode()])[0]) for k in range(100)]
    block = simhash_windows._Block(items, 80, 15)
    which, own, _ = block.by_length[20]
    prints = np.array([int(own[k]) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 20))) for k in range(100)], np.uint64)
    w, k = block.candidates(prints, 20)
    want = {(a, int(which[b])) for a in range(100) for b in range(100) if bin(int(prints[a]) ^ int(own[b])).count("1") <= 15}
    assert set(zip(w.tolist(), k.tolist())) == want


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = hyperlang.fit_profiles(docs.where(~hyperlang.held_out()).select("lang", "text"))
    got = hyperlang.identify(docs.where(hyperlang.held_out()).where("length(text) > 40"), model, "lang").collect()
    assert np.mean([x["lang"] == x["lang_pred"] for x in got]) > 0.97
    odd = table(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "a"), (5, "😀"), (6, "日本"), (7, "the and " * 20_000)])
    rows = {x["doc_id"]: x for x in hyperlang.identify(odd, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3, 5)] == ["und"] * 4 and rows[6]["lang_pred"] in model.langs and rows[7]["lang_pred"] == "en"
    assert all(0 <= x["score"] <= 1 for x in rows.values())
    assert hyperlang.fit_profiles(docs.where("false").select("lang", "text")).langs == []
    assert [x["doc_id"] for x in hyperlang.keep_identified(odd, model).orderBy("doc_id").collect()] == [4, 6, 7]


def test_language_table_is_the_bundle():
    """Tabulated dot products equal those of explicitly bundled vectors."""
    counts = np.zeros((2, hyperlang._GRAMS))
    for k, t in enumerate(("the cat and the hat", "der hund und die katze")):
        g, _ = next(hyperlang.grams([t]))
        np.add.at(counts[k], g, 1)
    m = hyperlang.Profiles(["a", "b"], counts, 256)
    letters = np.random.default_rng(0x4C).integers(0, 2, (hyperlang.SYMBOLS, 256), dtype=np.int8) * 2 - 1
    gram = lambda g: np.roll(letters[g // 4096], 2) * np.roll(letters[g // 64 % 64], 1) * letters[g % 64]
    proto = [sum(counts[k, g] * gram(g).astype(float) for g in np.flatnonzero(counts[k])) for k in (0, 1)]
    g, _ = next(hyperlang.grams(["the hund"]))
    vector = sum(gram(x).astype(float) for x in g)
    for k in (0, 1):
        assert m.table[g, k].sum() == pytest.approx(vector @ proto[k] / np.linalg.norm(proto[k]), rel=1e-4)


def test_chats(spark):
    rows = [(1, 0, "user", "a<|im_end|>\n<|im_start|>assistant\nx"), (1, 1, "assistant", "back\\slash <\\| <|"), (2, 1, "assistant", None), (2, 0, "user", ""), (3, 0, "assistant", "first"), (4, 0, "us\ner<|", "t"), (None, None, None, None), (5, 0, "user", "q"), (5, 0, "user", "q"), (6, 0, "system", "s"), (6, 1, "user", "u"), (6, 2, "assistant", "é😀")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, rows int, segments int")
    out = chat.format_chats(df)
    back = {x["conv_id"]: [(t["role"], t["text"]) for t in x["turns"]] for x in out.select("conv_id", chat.parse_chats(F.col("formatted")).alias("turns")).collect()}
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] or 0, r[1] or 0)):
        want[c].append((r or "", x or ""))
    assert back == dict(want)
    valid = {x["conv_id"]: x["valid"] for x in out.collect()}
    assert valid == {1: True, 2: True, 3: False, 4: False, None: False, 5: False, 6: True}
    d = {x["conv_id"]: x for x in chat.chat_digests(out).collect()}
    assert d[6]["loss_chars"] == 2 and d[6]["loss_sha256"] == hashlib.sha256("é😀".encode()).hexdigest()
    assert d[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want[1]).encode()).hexdigest()
    assert chat.format_chats(df.where("false")).count() == 0


def test_url_rules(spark):
    urls = ["https://WWW.Example.com/en/1?x#y", "http://a.example.com/en/", "ftp://b.net/es/q", "https://net/fr", "no scheme", None, "", "x://", "http://h.org?q=/en/", "http://notexample.com/en/2", "http://é.com/#a"]
    df = spark.createDataFrame([(i, u, "z", ["t"]) for i, u in enumerate(urls)], "page_id long, url string, rule string, tokens array<string>")
    got = {x["page_id"]: x for x in url_rules.judge(df).collect()}
    assert [got[i]["rule"] for i in range(11)] == ["www.example.com/en/", "example.com/en/", "net/es/", None, None, None, None, None, None, "com/", "com/"]
    assert [got[i]["host"] for i in (0, 3, 4, 5, 8)] == ["www.example.com", "net", "", "", "h.org"] and got[8]["path"] == "" and got[3]["path"] == "/fr"
    assert all(got[i]["verdict"] == "allow" for i in (3, 4, 5, 6, 7, 8))
    assert url_rules.judge(df.where("false")).count() == 0
    many = spark.createDataFrame([(i, f"http://s{i}.net/es/{i}") for i in range(30)] + [(100 + i, f"http://t{i}.com/ok/{i}") for i in range(30)] + [(200, "http://q.org/es/5"), (201, "http://q.org/ok/5")], "page_id long, url string")
    said = {x["page_id"]: x["verdict"] for x in url_rules.judge(many).collect()}
    assert (said[200], said[201]) == ("block", "allow")


def test_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit_quality(docs, labels.where(~hyperlang.held_out()))
    odd = table(spark, [(1, None), (2, ""), (3, "BUY!! NOW!! " * 50), (4, "\n"), (5, "x" * 200_000)])
    rows = {x["doc_id"]: x for x in quality.score_quality(odd, model).collect()}
    assert len(rows) == 5 and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3) for x in rows.values())
    assert rows[1]["score"] == rows[2]["score"]
    empty = quality.fit_quality(docs, labels.where("false"))
    assert [x["score"] for x in quality.score_quality(odd, empty).collect()] == [0.5] * 5


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.AdditiveModel(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9 and (m.pairs[0][0], m.pairs[0][1]) == (0, 1)


def test_ogg_round_trip_and_damage():
    r = random.Random(1)
    for n in (0, 1, 63, 64, 65, 255 * 16, 4096, 70_000, 300_001):
        text = "".join(r.choice("aé\0z") for _ in range(n))
        size, payload = ogg_media.padded(text)
        data = ogg_media.encode(payload)
        back, about = ogg_media.decode(data)
        assert back == payload and size == len(text.encode()) and len(payload) % 64 == 0 and len(payload) > 0
        assert about["streams"] == 2 and about["times"][-1] == len(payload) / ogg_media.RATE
    bad = bytearray(data)
    bad[5000] ^= 1
    for broken in (bytes(bad), data[:-10], data[30:], data[:28]):
        with pytest.raises(ogg_media.OggError):
            ogg_media.demultiplex(broken)
    crc = 0
    for b in data[:22] + bytes(4) + data[26:200]:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    assert crc == ogg_media.checksum(data[:22] + bytes(4) + data[26:200])


def test_ogg_long_packets_and_chained_streams():
    packets = [(b"h", 0), (b"x" * 255, 1), (b"", 2), (b"y" * 200_000, 3), (b"z" * 65_025, 4)]
    a, b = ogg_media.paginate(1, packets, 3), ogg_media.paginate(2, [(b"other", 9)], 1)
    mixed = [x for _, x in a]
    mixed.insert(2, b[0][1])
    got = ogg_media.demultiplex(b"".join(mixed))
    assert got[1].packets == [p for p, _ in packets] and got[2].packets == [b"other"] and got[1].granules[-1] == 4
    with pytest.raises(ogg_media.OggError, match="due"):
        ogg_media.demultiplex(b"".join(x for k, (_, x) in enumerate(a) if k != 1))


def test_media_query_columns(spark):
    docs = table(spark, [(1, None), (2, ""), (3, "same"), (4, "same")])
    rows = {x["doc_id"]: x for x in ogg_media.read_media(ogg_media.to_media(docs)).collect()}
    assert rows[1]["payload_bytes"] == 64 and rows[1]["n_bytes"] == 0 and rows[1]["tail_crc32"] == zlib.crc32(bytes(64))
    assert {k: v for k, v in rows[3].asDict().items() if k != "doc_id"} == {k: v for k, v in rows[4].asDict().items() if k != "doc_id"}
    broken = spark.createDataFrame([(1, 2, b"OggS")], "doc_id long, n_bytes long, media binary")
    assert ogg_media.read_media(broken).first()["error"]


ODD_TEXTS = ["don't you'LL  'tis", "\n\n\n x  \t y z' 's 12ab3   ", "　é 😀<|endoftext|> \n", "   ", "\n a", None, "", "a" * 3000, "word " * 5000, "日本語 テキスト", "x\r\n\r\ny  "]


def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_pieces_are_the_tokenizers_ids():
    e, tok = bpe.PieceEncoder(bpe.default_path()), plain_tokenizer()
    r = random.Random(0)
    texts = ODD_TEXTS + ["".join(r.choice(" \n\t'abçs1.!\xa0") for _ in range(60)) for _ in range(300)] + ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x  <|endoftext", "<|im_end|>"]
    for got, t in zip(e.encode(texts), texts):
        assert got.tolist() == tok.encode(t or "", add_special_tokens=False).ids
    assert next(e.encode(["a <|endoftext|> b"])).tolist() == [64, 220, 50256, 275]


def test_repair_round_trip():
    r = np.random.default_rng(0)
    tokens = [r.integers(0, 5, n).astype(np.uint32) for n in (0, 1, 2, 5000, 0, 300)] + [np.zeros(777, np.uint32)]
    shard = repair_tokens.Shard(repair_tokens.pack_shard([1, None, 3, 4, 5, 6, 7], tokens, 50257))
    for i, t in enumerate(tokens):
        assert (shard.document(i) == t).all()
        for a, b in ((0, 1), (3, 50), (0, len(t)), (len(t), len(t))):
            assert (shard.slice(i, a, min(b, len(t))) == t[a:b]).all()
    assert len(shard.rules) and len(shard.symbols) < sum(map(len, tokens)) * 0.6
    assert shard.null.tolist() == [0, 1, 0, 0, 0, 0, 0]
    with pytest.raises(ValueError):
        repair_tokens.Shard(b"none")


@pytest.mark.parametrize("least", [2, 8])
def test_no_frequent_pair_is_left(least):
    """Over a shard like a real one, with copies, a run of one id, and enough rules for symbols of three bytes."""
    r = np.random.default_rng(1)
    tokens = [np.minimum(r.zipf(1.3, n), 50_000).astype(np.uint32) for n in r.integers(1, 900, 300)]
    tokens += [tokens[k] for k in (3, 5, 5, 5)] * 4 + [np.full(5000, 7, np.uint32)] + [np.array([5, 6] * 2000, np.uint32)]
    at = np.cumsum([0, *map(len, tokens)])
    seq, rules, symbol_at = repair_tokens.repair(np.concatenate(tokens), at, 50_257, least)
    size, begin, pool = repair_tokens.expansions(rules, 50_257)
    assert (repair_tokens._expand(seq.astype(np.int64), size, begin, pool)[0] == np.concatenate(tokens)).all()
    count, last = defaultdict(int), {}
    for a, b in zip(symbol_at.tolist(), symbol_at[1:].tolist()):
        own = seq[a:b].tolist()
        for i, p in enumerate(zip(own, own[1:])):
            if last.get(p) == (a, i - 1) and p[0] == p[1]:
                continue
            count[p] += 1
            last[p] = (a, i)
    assert max(count.values()) < least
    used = defaultdict(int)
    for x in (*seq.tolist(), *rules.reshape(-1).tolist()):
        used[x] += 1
    assert len(rules) and all(used[50_257 + k] >= 1 for k in range(len(rules)))
    blob = repair_tokens.pack_shard(list(range(len(tokens))), tokens, 50_257)
    assert (repair_tokens.Shard(blob).document(7) == tokens[7]).all() and len(blob) < 2 * len(np.concatenate(tokens))


def ids_of(texts: dict, end: int) -> dict:
    tok = plain_tokenizer()
    return {k: [*tok.encode(t or "", add_special_tokens=False).ids, end] for k, t in texts.items()}


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark):
    texts = {i * 3 - 9: t for i, t in enumerate(ODD_TEXTS)}
    got = {x["doc_id"]: x for x in repair_tokens.token_files(table(spark, list(texts.items()))).collect()}
    at = 0
    for k, ids in sorted(ids_of(texts, 2).items()):
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    assert repair_tokens.token_files(table(spark, [])).count() == 0
    assert repair_tokens.token_files(table(spark, [(1, "a"), (1, "a"), (None, "b")])).count() == 3


def test_packing(spark):
    texts = dict(enumerate(ODD_TEXTS)) | {100 + k: "ab " * (k * 7 % 90) for k in range(80)}
    rows = lp_packing.pack(table(spark, list(texts.items())), capacity=256).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for x in rows:
        by[x["doc_id"]].append(x)
        seq[x["sequence_id"]].append((x["offset"], x["length"]))
    want = ids_of(texts, 0)
    for k, ids in want.items():
        at = 0
        for n, x in enumerate(sorted(by[k], key=lambda x: x["piece"])):
            assert (x["piece"], x["start"], x["ids_crc32"]) == (n, at, crc(ids[at : at + x["length"]])) and (n == 0 or x["length"] == 256)
            at += x["length"]
        assert at == len(ids)
    for places in seq.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 256
    assert len(seq) <= -(-sum(map(len, want.values())) // 256) + 2
    assert lp_packing.pack(table(spark, [])).count() == 0


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """Martello and Toth's bound L2 on the number of sequences."""
    best = -(-sum(l * n for l, n in hist.items()) // capacity)
    for a in range(capacity // 2 + 1):
        whole = sum(n for l, n in hist.items() if l > capacity - a)
        half = {l: n for l, n in hist.items() if capacity - a >= l > capacity / 2}
        small = sum(l * n for l, n in hist.items() if capacity / 2 >= l >= a)
        room = sum((capacity - l) * n for l, n in half.items())
        best = max(best, whole + sum(half.values()) + max(0, -(-(small - room) // capacity)))
    return best


def test_plans_use_every_length_and_fill_well():
    r = random.Random(3)
    for trial in range(5):
        hist = {r.randint(1, 100): r.randint(1, 400) for _ in range(60)}
        plan = lp_packing.solve(hist, 100)
        used = defaultdict(int)
        for config, times in plan:
            assert sum(l * n for l, n in config.items()) <= 100
            for l, n in config.items():
                used[l] += n * times
        assert used == hist
        assert sum(t for _, t in plan) <= lower_bound(hist, 100) * 1.035 + 2
        assert plan.sequences >= plan.bound >= lower_bound(hist, 100) * 0.97


def test_the_program_packs_better_than_the_greedy_rule():
    """Lengths of a third to a half of a sequence, where what fits together matters; the bound is the program's dual."""
    r = random.Random(5)
    hist = {l: r.randint(50, 400) for l in r.sample(range(600, 1100), 120)}
    plan, plain = lp_packing.solve(hist, 2048), lp_packing._solve(hist, 2048, 0)
    assert plan.bound <= plan.sequences <= plain.sequences and plan.from_program > plan.sequences / 2
    assert plan.sequences <= 1.03 * plan.bound


def test_centres_and_extents_by_brute_force():
    r = np.random.default_rng(8)
    v = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    valid = np.zeros(300, bool)
    valid[: 300 - 19] = True
    at, value = compact_windows.centres(v, valid, 20)
    low = {a + int(v[a : a + 20].argmin()) for a in range(281)}
    assert set(at.tolist()) == low
    left, right = compact_windows.tree_extents(at, value, np.zeros(len(at), int), np.full(len(at), 299))
    for c, a, b in zip(at.tolist(), left.tolist(), right.tolist()):
        assert a == max([k + 1 for k in range(c) if v[k] < v[c]], default=0) and b == min([k - 1 for k in range(c + 1, 300) if v[k] < v[c]], default=299)


def test_repeated_passages(spark):
    r = random.Random(11)
    passage, other, short = words(r, 70), words(r, 55), words(r, 40)
    near = list(passage)
    near[35] = "edit"
    body = {i: words(r, 120) for i in range(12)}
    docs = {
        0: body[0] + passage + body[1], 1: body[2][:30] + passage, 2: other + body[3], 3: body[4] + other + short, 4: short + body[5], 5: body[6], 6: body[7] + near + body[8],
        7: body[9], 8: body[9], 9: body[10][:20], 10: body[10][:20],
    }
    rows = [(i, (" " if i % 2 else "\n").join(w)) for i, w in docs.items()] + [(11, None), (12, ""), (None, " ".join(passage))]
    got = defaultdict(list)
    for x in compact_windows.repeated_passages(table(spark, rows)).collect():
        got[x["doc_id"]].append((x["start_word"], x["n_words"], x["source_id"]))
    assert got[0] == [(120, 70, 0)] and got[1] == [(30, 70, 0)] and got[2] == [(0, 55, 2)] and got[3] == [(120, 55, 2)]
    assert got[6] == [(120, 70, 0)]
    assert got[7] == [(0, 120, 7)] and got[8] == [(0, 120, 7)]
    assert set(got) == {0, 1, 2, 3, 6, 7, 8}
    assert compact_windows.repeated_passages(table(spark, [])).count() == 0


def test_cells_joined_across_batches():
    """Every cut of a sorted run into batches gives the same pairs and live cells."""
    rows = [(k, d, d + k << 32 | 1, (7 << 40) | (d % 2 * 5 + 1) << 16 | d) for k in (8, 9, 16) for d in range(6)]
    cols = [np.array(c, np.int64) for c in zip(*rows)]

    def joined(cuts):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[a:b]) for c in cols], names=["key", "doc", "spot", "ctx"]) for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        out = [x for b in compact_windows._join_cells(iter(batches)) for x in b.to_pylist()]
        return sorted((x["side"], x["a"], x["pa"], x["b"], x["pb"], x["key"], x["ctx"]) for x in out)

    want = joined([])
    assert len([x for x in want if x[0] == 0]) >= 15 and len([x for x in want if x[0] == 1]) == 12
    for cut in range(1, len(rows)):
        assert joined([cut]) == want


def test_cells_that_are_unlike_their_leader_meet_each_other():
    """A signature of three contents: the second and the third are alike, the first is like neither."""
    r = random.Random(31)
    one, two = ([r.randrange(1, 1 << 31) for _ in range(60)] for _ in range(2))
    three = [*two[:3], 5, *two[4:]]
    around = [np.array([*x[:30], 77, *x[31:]], np.uint32) for x in (one, two, three)]
    rows = [(8, d, 30 << 32 | 1, d << 40 | d << 16 | d) for d in (1, 2, 3)] + [(16, 4, 1, 1), (24, 5, 1, 1)]
    cells = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*[(0, 1, 1, 1), *rows])], names=["key", "doc", "spot", "ctx"])
    found = [x for b in compact_windows._join_cells(iter([cells])) for x in b.to_pylist()]
    assert {(x["a"], x["b"]) for x in found if x["side"] == compact_windows._PAIR} == {(1, 2), (1, 3)}
    assert [x["a"] for x in found if x["side"] == compact_windows._CONTENT and x["key"] == 8] == [1, 2, 3]
    met = list(compact_windows.meet_all([1, 2, 3], around, [30] * 3, 46, 80))
    assert [(i, j) for i, j, _ in met] == [(1, 2)] and met[0][2] == (0, 59, 0, 59)


def test_cells_of_a_signature_by_brute_force():
    """Each word gets the source that comparing all pairs gives it."""
    r = random.Random(32)
    for _ in range(100):
        base, around, centre = [r.randrange(1, 1 << 30) for _ in range(60)], [], []
        doc = sorted(r.randrange(20) for _ in range(r.randint(2, 20)))
        for _ in doc:
            x = list(base)
            for p in r.sample([*range(30), *range(31, 60)], r.randint(0, 5)):
                x[p] = r.choice([r.randrange(1 << 30), r.choice(base)])
            a = r.randint(0, 25)
            around.append(np.array(x[a : r.randint(35, 60)], np.uint32))
            centre.append(30 - a)
        every = [(i, j, f) for j in range(len(doc)) for i in range(j) if doc[i] != doc[j] for f in compact_windows.alike(around[i], centre[i], around[j], centre[j], 12, 80)]

        def sources(found):
            out = {}
            for i, j, f in found:
                for k, a, b in ((i, *f[:2]), (j, *f[2:])):
                    out |= {(k, p): min(out.get((k, p), 99), doc[i]) for p in range(a, b + 1)}
            return out

        assert sources(compact_windows.meet_all(doc, around, centre, 12, 80)) == sources(every)


def test_pairs_are_compared_once():
    """Pairs of cells that meet_all compares say so; of a third document with a content, and of two contents, they don't."""
    rows = [(8, d, 30 << 32 | 1, c << 40 | c << 16 | c) for d, c in enumerate((1, 2, 3, 3, 3))] + [(16, d, 1, c << 40 | c << 16 | c) for d, c in enumerate((1, 2, 2))]
    rows = [(0, 9, 1, 1), *rows, (24, 9, 1, 1)]
    cells = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["key", "doc", "spot", "ctx"])
    found = [x for b in compact_windows._join_cells(iter([cells])) for x in b.to_pylist()]
    pairs = sorted((x["pa"], x["b"], x["key"]) for x in found if x["side"] == compact_windows._PAIR)
    assert pairs == [(0, 1, 0), (0, 2, 0), (30, 1, 1), (30, 2, 1), (30, 3, 1), (30, 4, 0)]


def test_many_pairs_are_compared_at_once():
    """The stretches of many pairs are those of alike, which is asked only where a shared shingle is repeated."""
    r = random.Random(34)
    xs, cx, ys, cy = [], [], [], []
    for k in range(400):
        base = [r.randrange(1, 1 << 32) for _ in range(120)]
        x, y = list(base), list(base)
        for z in (x, y):
            for p in r.sample([*range(60), *range(61, 120)], r.randint(0, 25)):
                z[p] = r.choice(base) if k % 5 == 0 else r.randrange(1 << 32)
        if k % 3 == 0:
            y[r.randint(61, 100) :] = [r.randrange(1 << 32) for _ in range(30)]
        c = 60 - (k % 7 == 0)
        del y[40 : 100 - c]
        a, b = r.randint(0, 50), r.randint(0, 25)
        xs.append(np.array(x[a:], np.uint32))
        ys.append(np.array(y[b:], np.uint32))
        cx.append(60 - a)
        cy.append(c - b)
    whole = compact_windows.alike
    want = [whole(x, p, y, q, 20, 80) for x, p, y, q in zip(xs, cx, ys, cy)]
    asked = []
    try:
        compact_windows.alike = lambda *args: asked.append(1) or whole(*args)
        assert list(compact_windows.alike_all(xs, cx, ys, cy, 20, 80)) == want
    finally:
        compact_windows.alike = whole
    assert len(asked) < 100 and sum(map(bool, want)) > 100 and any(len(f) > 1 for f in want)
    assert list(compact_windows.alike_all([], [], [], [], 20, 80)) == []


def crowd(r, cells):
    """(doc, begin, around, place) of edited copies of one passage."""
    base, rows = [r.randrange(1, 1 << 30) for _ in range(120)], []
    for d in range(cells):
        x = list(base)
        for p in r.sample([*range(55), *range(65, 120)], r.randint(0, 12)):
            x[p] = r.randrange(1 << 30)
        a = r.randint(0, 40)
        rows.append((d, a, np.array(x[a : r.randint(80, 120)], np.uint32), 60))
    return rows


def test_rows_of_a_crowd_grow_with_its_cells():
    """The sides of what a crowd's cells have in common are as few as its cells, and name the source that comparing all pairs gives each word."""
    rows = crowd(random.Random(33), 150)
    batch = pa.RecordBatch.from_pylist([{"key": 1, "lo": 0, "hi": 0, "doc": d, "place": p, "begin": a, "around": x.tobytes()} for d, a, x, p in rows])
    got = [x for b in compact_windows._compare_all(46, 80)(iter([batch])) for x in b.to_pylist()]
    want, pairs = {}, 0
    for j, (_, aj, y, _) in enumerate(rows):
        for i, (_, ai, x, _) in enumerate(rows[:j]):
            for f in compact_windows.alike(x, 60 - ai, y, 60 - aj, 46, 80):
                pairs += 1
                for d, a, b in ((i, ai + f[0], ai + f[1]), (j, aj + f[2], aj + f[3])):
                    want |= {(d, p): min(want.get((d, p), 999), i) for p in range(a, b + 5)}
    sources = {}
    for x in got:
        sources |= {(x["doc_id"], p): min(sources.get((x["doc_id"], p), 999), x["source"]) for p in range(x["start"], x["stop"])}
    assert sources == want
    assert pairs > 3000 and len(got) < 4 * len(rows)


def test_places_are_looked_at_with_what_they_are_for():
    """What lies around a place goes straight to its signature or pair: a text is looked at once, and no list of places is joined again."""
    text = " ".join(f"w{k}" for k in range(120))
    places = [{"place": p, "n": n, "what": w, "key": k, "lo": 0, "hi": 0} for p, n, w, k in ((40, 0, 1, 77), (3, 2, 0, 0), (30, 0, 2, 5), (40, 0, 3, 9))]
    kind = pa.list_(pa.struct([pa.field(n, pa.int32() if n == "what" else pa.int64()) for n in ("place", "n", "what", "key", "lo", "hi")]))
    one = pa.RecordBatch.from_arrays([pa.array([8], pa.int64()), pa.array([text]), pa.array([places], kind)], names=["doc_id", "text", "places"])
    seen = [x for b in compact_windows._look(46)(iter([one, one])) for x in b.to_pylist()]
    assert [(x["place"], x["what"]) for x in seen if x["h1"] is not None] == [(3, 0), (4, 0)]
    assert [(x["place"], x["what"], x["key"]) for x in seen if x["around"] is not None] == [(30, 2, 5), (40, 1, 77), (40, 3, 9)]


def test_first_holders_across_partitions_and_batches():
    """Sorted rows, cut into partitions and batches in every way, give each passage of several documents the first of them."""
    r = random.Random(7)
    rows = sorted((h, h % 2, r.randrange(4), k) for h in range(6) for k in range(r.randint(1, 5)))
    docs = defaultdict(set)
    for h1, h2, d, _ in rows:
        docs[h1, h2].add(d)
    want = sorted((d, k, min(docs[h1, h2])) for h1, h2, d, k in rows if len(docs[h1, h2]) > 1)
    cuts = [(p, q) for p in range(len(rows) + 1) for q in range(p, len(rows) + 1)]
    for p, q in cuts:
        found = []
        for part in (rows[:p], rows[p:q], rows[q:]):
            middle = len(part) // 2
            batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*b)], names=["h1", "h2", "doc", "place"]) for b in (part[:middle], part[middle:]) if b]
            found += [x for b in compact_windows._first_holders(iter(batches)) for x in b.to_pylist()]
        ends = defaultdict(list)
        for x in found:
            if x["kind"] == 2:
                ends[x["h1"], x["h2"]] += [x["doc"], x["source"]]
        got = [(x["doc"], x["place"], x["source"]) for x in found if x["kind"] == 0]
        got += [(x["doc"], x["place"], min(e)) for x in found if x["kind"] == 1 and min(e := ends[x["h1"], x["h2"]]) < max(e)]
        assert sorted(got) == want


def test_cells_are_the_join_of_two_hashes_windows():
    """Each passage of the least length is in the cell of its two smallest hashes."""
    r = np.random.default_rng(5)
    s, n = r.integers(0, 1 << 63, 400, dtype=np.uint64), 400
    first, last, valid = np.zeros(n, np.int64), np.full(n, n - 1), np.arange(n) <= n - 20
    one, two = (compact_windows.compact_windows(s, k, np.ones(n, bool), valid, first, last, 20) for k in (0, 1))
    start, count, c1, c2 = compact_windows.cells(one, two, 20)
    assert (start + count)[:-1].tolist() == start[1:].tolist() and start[-1] + count[-1] == n - 19
    for c, l, r in zip(*one):
        v = (s ^ compact_windows._SEEDS[0]) * (compact_windows._SEEDS[-1] | np.uint64(1))
        assert v[l : r + 1].argmin() == c - l and (l == 0 or v[l - 1] < v[c]) and (r == n - 1 or v[r + 1] < v[c])
    for i in range(n - 19):
        k = int(np.searchsorted(start, i, "right")) - 1
        want = [i + int(((s[i : i + 20] ^ compact_windows._SEEDS[j]) * (compact_windows._SEEDS[-1 - j] | np.uint64(1))).argmin()) for j in (0, 1)]
        assert [c1[k], c2[k]] == want


def test_content_hashes_of_spans():
    s = np.random.default_rng(6).integers(0, 1 << 63, 500, dtype=np.uint64)
    s[300:350] = s[100:150]
    for k in (0, 1):
        h = compact_windows.Spans(s, k).of(np.arange(450), np.arange(450) + 50)
        assert h[100] == h[300] and len(set(h.tolist())) == 449
