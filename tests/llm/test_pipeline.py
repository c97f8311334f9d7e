"""The pipeline on documents whose fate is known."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tokenizers import Tokenizer  # noqa: E402

from tilewright.llm import bpe  # noqa: E402
from tilewright.llm.scratch import Scratch  # noqa: E402


def text(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice("abcdefghiklmnop") for _ in range(r.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(21)
    item, passage = text(r, 30), text(r, 80)
    docs = {i: text(r, r.randint(20, 200)) for i in range(40)}
    docs[50] = docs[3] + text(r, 1)  # near copy
    docs[51] = list(docs[4])  # copy
    docs[52] = text(r, 40) + passage + text(r, 40)
    docs[53] = text(r, 25) + passage + text(r, 25)
    docs[54] = text(r, 30) + item + text(r, 30)
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in docs.items()] + [(60, None, None, None, None), (61, "12 34 !", None, "s", 7), (62, "", "en", "s", 0)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, " ".join(text(r, 20)))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    want = {i: " ".join(w) for i, w in docs.items() if i not in (50, 51, 54)}
    w = docs[53]
    want[53] = " ".join(w[:25] + w[105:])
    return str(folder), want


def test_stages(spark, corpus):
    folder, want = corpus
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.table(name, stage(spark, docs, folder))
        assert docs.columns == columns
        seen.append({x["doc_id"] for x in docs.collect()})
    everything = {*range(40), *range(50, 55), 60, 61, 62}
    assert seen[0] == everything - {60, 61, 62}
    assert seen[1] == seen[0] - {50, 51}
    assert seen[2] == seen[1] and seen[3] == seen[2] - {54}
    assert {x["doc_id"]: " ".join(x["text"].split()) for x in docs.collect()} == want


def test_run_packs_what_is_left(spark, corpus):
    folder, want = corpus
    rows = corpus_pipeline.run(spark, folder).collect()
    got = defaultdict(list)
    for x in rows:
        got[x["doc_id"]].append(x)
    assert set(got) == set(want)
    tok = Tokenizer.from_file(bpe.default_path())
    for i in set(want) - {53}:
        ids = [*tok.encode(want[i], add_special_tokens=False).ids, 0]
        assert sum(x["length"] for x in got[i]) == len(ids) and got[i][0]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert max(x["offset"] + x["length"] for x in rows) <= 2048


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
