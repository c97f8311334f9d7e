"""Every query of the library's own catalog against its SQL twin."""

import pytest

from tilewright import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_twin(name, spark, duck, same, sf):
    same(catalog.QUERIES[name](spark, sf), duck, catalog.ORACLE[name])


@pytest.mark.parametrize("name", ["model_logistic", "model_sgd", "model_huber", "model_tree", "model_vote", "model_kernel_and_net"])
def test_models_answer_for_every_validation_row(name, spark, sf):
    rows = catalog.QUERIES[name](spark, sf).collect()
    labels = {str(x["label"]) for x in spark.read.parquet(f"{sf}/embeddings.parquet").select("label").distinct().collect()}
    ids = [x["vec_id"] for x in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 10 = 7").select("vec_id").collect()]
    by = {}
    for x in rows:
        by.setdefault(x["config"] if "config" in x else "", []).append(x)
    for own in by.values():
        assert sorted(x["row_id"] for x in own) == sorted(ids) and {str(x["predicted"]) for x in own} <= labels


@pytest.mark.parametrize("name", ["rank_mutual_info", "rank_l1"])
def test_rankings_are_permutations(name, spark, sf):
    rows = sorted(catalog.QUERIES[name](spark, sf).collect(), key=lambda x: x["rank"])
    assert [x["rank"] for x in rows] == list(range(1, len(rows) + 1)) and len({x["feature"] for x in rows}) == len(rows) == 63
    scores = [x["score"] for x in rows]
    assert all(a >= b for a, b in zip(scores, scores[1:])) and min(scores) >= 0


def test_entry_without_corpus_operators(spark, monkeypatch):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    monkeypatch.setattr(e, "llm", None)
    assert set(e.queries()) == set(catalog.QUERIES)
    assert set(e.oracle_sql()) == set(catalog.ORACLE)
