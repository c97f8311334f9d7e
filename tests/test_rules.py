"""Small hand-computed cases: nulls, ties, empty tables, contracts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import keys as K
from tilewright.functions.distributions import chi2_sf, f_sf
from tilewright.operators import audit, bootstrap, flow, ledger, matching, metrics, models, neighbours, preparation, ranking, selection, splitting, tiles
from tilewright.operators.matching import ContractError
from tilewright.sources import images, reports, tables


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "base", "stem"), [("C:\\a\\B.JPG", "b.jpg", "b"), (" x/y.tar.gz ", "y.tar.gz", "y.tar"), (".b", ".b", ".b"), ("a.", "a.", "a."), (None, "", ""), ("", "", "")])
def test_names(spark, raw, base, stem):
    assert one(spark, raw, K.basename) == base
    assert one(spark, raw, K.stem) == stem


@pytest.mark.parametrize(("raw", "value"), [(None, None), ("", None), ("abc", None), ("inf", None), ("1d", None), ("1e3", 1000.0), (" -1 ", -1.0), (".5", 0.5), ("1_000", None)])
def test_numbers(spark, raw, value):
    assert one(spark, raw, K.finite_number) == value


def test_quartiles_and_undefined_measures(spark):
    rows = [(1, 1, float(v), 7.0, -float(v)) for v in (1, 2, 4, 8)] + [(1, 2, 5.0, 5.0, 5.0)] + [(1, 3, v, v, v) for v in (-1.0, 1.0)]
    df = spark.createDataFrame(rows, "image int, tile int, b double, g double, r double")
    got = {r["tile"]: r for r in tiles.tile_statistics(df, ["image", "tile"], ["b", "g", "r"]).collect()}
    a = got[1]
    assert (a["b_q1"], a["b_q3"], a["b_range"], a["n"]) == (1.75, 5.0, 7.0, 4)
    assert a["b_variance"] == pytest.approx(9.583333333) and a["g_cv"] == 0
    assert a["alpha"] is None  # the channels' sum is flat
    assert all(got[2][f"{c}_{m}"] is None for c in "bgr" for m in tiles.MEASURES)
    assert got[3]["b_cv"] is None and got[3]["alpha"] == pytest.approx(1.0)


def test_image_tiles_equal_the_table_form(spark):
    x = np.random.default_rng(1).integers(0, 256, (4, 4, 3), dtype=np.uint8)
    f = images.tile_features(x, 2)
    rows = [(i, j, *map(float, x[i, j])) for i in range(4) for j in range(4)]
    df = spark.createDataFrame(rows, "y int, x int, b double, g double, r double").withColumn("tile", tiles.tile_number(F.col("x"), F.col("y"), F.lit(4), 2)).withColumn("image", F.lit(1))
    wide = tiles.to_vectors(tiles.tile_statistics(df, ["image", "tile"], ["b", "g", "r"]), "image", "tile", ["b", "g", "r"]).first()
    assert wide["tiles"] == 4
    assert np.allclose(np.array(wide["features"], float), f.reshape(-1))
    assert len(images.tile_names(4)) == 100
    with pytest.raises(ContractError):
        images.tile_features(x, 3)


def test_image_files(spark, tmp_path):
    import struct
    import zlib

    def png(path, h, w):
        raw = b"".join(b"\0" + bytes((i * j * 7 + k) % 256 for j in range(w) for k in range(3)) for i in range(h))

        def chunk(kind, data):
            return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    png(tmp_path / "A.PNG", 64, 32)
    png(tmp_path / "odd.png", 40, 32)
    (tmp_path / "bad.png").write_bytes(b"no image")
    (tmp_path / "notes.txt").write_bytes(b"no image either")
    got = {r["file_name"]: r for r in images.extract(spark, str(tmp_path), 32, 3, "c").collect()}
    assert len(got["A.PNG"]["features"]) == 50 and got["A.PNG"]["issue"] is None and got["A.PNG"]["source_group"] == "a"
    assert set(got) == {"A.PNG", "odd.png", "bad.png"} and images.list_images(spark, str(tmp_path)).columns == ["path", "length"]
    assert got["bad.png"]["issue"] == "unreadable image" and "divide" in got["odd.png"]["issue"]
    assert images.file_hashes(spark, str(tmp_path)).count() == 3


def test_two_stage_match(spark):
    f = spark.createDataFrame([("a.png",), ("b.jpg",), ("c.jpg",), ("",), (None,)], "n string")
    g = spark.createDataFrame([("A.PNG", 1), ("b.png", 2), ("c.png", 3), ("c.gif", 4)], "filename string, gid int")
    got = {r["n"]: (r["gid"], r["matched_by"]) for r in matching.attach_groups(f, g, "n").collect()}
    assert got == {"a.png": (1, "name"), "b.jpg": (2, "stem"), "c.jpg": (None, None), "": (None, None), None: (None, None)}
    with pytest.raises(ContractError):
        matching.attach_groups(f, g.unionByName(g), "n")
    with pytest.raises(ContractError):
        matching.attach_groups(f, g, "n", strict=True)


def test_split_shares_and_disjointness(spark):
    rows = spark.createDataFrame([("x", f"g{i % 7}", i) for i in range(50)], "c string, g string, i int")
    for assign in (splitting.assign_groups, splitting.assign_groups_by_permutation):
        n = {r["split"]: r["count"] for r in assign(rows, "c", "g").groupBy("split").count().collect()}
        assert n == {"Test": 2, "Validation": 1, "Train": 4}
    done = splitting.split_rows(rows, "c", "g")
    assert done.count() == 50 and done.where("split is null").count() == 0
    splitting.require_disjoint(done, "g")
    with pytest.raises(ContractError):
        splitting.assign_groups(rows.where("g < 'g2'"), "c", "g")


def test_preparation_passes(spark):
    values = {"gap": [1, None, None, None, 9, 10], "flat": [7, None, 7, 7, 7, 7], "tight": [5, 5, 5, 5, 5, 9], "none": [None] * 6}
    rows = [("s", i, f, p, float(v) if v is not None else None, "Train") for p, (f, vs) in enumerate(values.items()) for i, v in enumerate(vs)]
    rows += [("s", 9, "tight", 2, 100.0, "Test")]
    long = spark.createDataFrame(rows, "scenario string, row_id int, feature string, pos int, value double, split string")
    p = {r["feature"]: r for r in preparation.fit(long).collect()}
    assert p["gap"]["median"] == 9 and (p["gap"]["q1"], p["gap"]["q3"]) == (9.0, 9.0)
    assert not p["flat"]["keep"] and not p["none"]["keep"]
    assert p["tight"]["upper"] is None and p["tight"]["max"] == 9
    out = {(r["row_id"], r["feature"]): r for r in preparation.transform(long, preparation.fit(long)).collect()}
    assert out[9, "tight"]["minmax"] > 1 and not out[9, "tight"]["high"]
    assert {f for _, f in out} == {"gap", "tight"}
    changed = long.withColumn("value", F.when(F.col("split") == "Test", F.lit(-1.0)).otherwise(F.col("value")))
    assert sorted(map(str, preparation.fit(changed).collect())) == sorted(map(str, preparation.fit(long).collect()))


def test_ranks_with_ties_and_odd_scores(spark):
    s = spark.createDataFrame([("s", "a", 0, 1.0), ("s", "b", 1, float("nan")), ("s", "c", 2, 1.0), ("s", "d", 3, float("inf")), ("s", "e", 4, None)], "scenario string, feature string, pos int, score double")
    assert [r["feature"] for r in ranking.rank(s, "m").orderBy("rank").collect()] == ["d", "a", "c", "b", "e"]
    assert ranking.valid_ks(60) == [25, 50, 60] and ranking.valid_ks(50, (25, 50)) == [25, 50]


def test_chi2_refuses_negatives(spark):
    long = spark.createDataFrame([("s", "a", 0, 0, -1.0), ("s", "a", 0, 1, 1.0)], "scenario string, feature string, pos int, label int, value double")
    with pytest.raises(Exception, match="negative"):
        ranking.chi2(long).collect()


def test_mutual_information():
    r = np.random.default_rng(3)
    y = r.integers(0, 2, 2000)
    assert ranking.mutual_information_of(y * 10 + r.normal(size=2000), y) == pytest.approx(math.log(2), abs=0.05)
    assert ranking.mutual_information_of(r.normal(size=2000), y) < 0.05


def test_tails():
    assert chi2_sf(4, 2) == pytest.approx(math.exp(-2))
    assert f_sf(4, 2, 10) == pytest.approx(1.8**-5)


def test_macro_labels_and_auc_ties(spark):
    p = spark.createDataFrame([(0, 0), (1, 2), (1, 1)], "t int, p int")
    s = metrics.summary(metrics.confusion(p, "t", "p")).first()
    assert s["macro_recall"] == pytest.approx((1 + 0.5 + 0) / 3) and s["accuracy"] == pytest.approx(2 / 3)
    a = spark.createDataFrame([(True, 1.0), (False, 1.0), (True, 2.0), (False, 0.0), (True, None)], "y boolean, s double")
    assert metrics.auc(a, "y", "s").first()[0] == pytest.approx((0.5 + 1 + 1 + 1) / 4)
    assert metrics.auc(a.where("y"), "y", "s").first()[0] is None


def test_bootstrap_contains_point(spark):
    rows = spark.createDataFrame([(f"g{i % 12}", i % 2, (i % 2) if i % 5 else 1 - i % 2) for i in range(120)], "g string, t int, p int")
    for draws in (bootstrap.hashed_draws(rows, "g", 40), bootstrap.numpy_draws(rows, "g", 40)):
        assert {r[0] for r in draws.groupBy("draw").agg(F.sum("times")).select("sum(times)").collect()} == {12}
        ci = bootstrap.intervals(bootstrap.distribution(rows, "t", "p", "g", draws), metrics.summary(metrics.confusion(rows, "t", "p")), ["accuracy"]).first()
        assert ci["lower"] <= ci["point"] <= ci["upper"]


def test_ledger_gate_and_errors(spark):
    grid = spark.createDataFrame([("a",), ("b",)], "run_id string")
    done = spark.createDataFrame([("a", "Completed"), ("b", "Failed")], "run_id string, status string")
    with pytest.raises(ContractError):
        ledger.require_complete(grid, done)
    rows = ledger.run_grid([{"run_id": "a"}, {"run_id": "b"}, {"run_id": "c"}], {"a"}, lambda r: {"x": 1} if r["run_id"] == "c" else 1 / 0)
    assert [(r["run_id"], r["status"]) for r in rows] == [("b", "Failed"), ("c", "Completed")]
    assert ledger.canonical('{"b":1,"a":2}') == '{"a":2,"b":1}'
    assert ledger.checked_names(["x", "x"], ("x",), "name") == ["x"]


def test_selection(spark):
    assert selection.feature_columns(["label", "Brange_1", "Unnamed: 0", " cv "]) == ["Brange_1", "cv"]
    lists = spark.createDataFrame([("s", "m", 2, 1, "a"), ("s", "m", 2, 2, "b")], "scenario string, method string, k int, rank int, feature string")
    assert selection.selected(lists, "s", "m", 2) == ["a", "b"]
    with pytest.raises(ContractError):
        selection.selected(lists, "s", "m", 3)
    with pytest.raises(ContractError):
        selection.require_winner({"accuracy": 0.5}, {"accuracy": 0.6})


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "All", "clean", "Train"), ("b", 2, "All", "clean", "Test")], "n string, v int, scenario string, variant string, split string")
    for suffix in (".csv", ".csv.gz", ".parquet"):
        path = tables.write_table(df, f"{tmp_path}/t{suffix}")
        assert tables.read_table(spark, path).count() == 2
    assert tables.find_table(spark, str(tmp_path), "t").endswith(".parquet")
    p = tables.write_partitioned(df, f"{tmp_path}/parts")
    assert tables.load_part(spark, p, "All", "clean", "Train").count() == 1
    with pytest.raises(ContractError):
        tables.load_part(spark, p, "All", "clean", "Test")
    tables.replace_atomically(df.where("v = 1"), f"{tmp_path}/t.parquet")
    assert spark.read.parquet(f"{tmp_path}/t.parquet").count() == 1
    tables.replace_atomically(df.where("v = 2"), f"{tmp_path}/t.csv.gz")
    assert [r["n"] for r in tables.read_table(spark, f"{tmp_path}/t.csv.gz").collect()] == ["b"]

    def refuse(new):
        raise ContractError(f"{new.count()} rows")

    with pytest.raises(ContractError, match="2 rows"):
        tables.replace_atomically(df, f"{tmp_path}/t.csv.gz", refuse)
    assert tables.read_table(spark, f"{tmp_path}/t.csv.gz").count() == 1
    assert not [p for p in tmp_path.iterdir() if ".new-" in p.name or ".old-" in p.name]
    tables.write_table(df.repartition(2), f"{tmp_path}/ordered.csv", "v")
    assert [r["v"] for r in tables.read_table(spark, f"{tmp_path}/ordered.csv").collect()] == ["1", "2"]
    tables.claim_lock(spark, f"{tmp_path}/lock")
    with pytest.raises(ContractError):
        tables.claim_lock(spark, f"{tmp_path}/lock")
    tables.write_json(spark, {"a": 1}, f"{tmp_path}/m.json")
    assert tables.read_json(spark, f"{tmp_path}/m.json") == {"a": 1}


def test_neighbours_and_votes(spark):
    rows = spark.createDataFrame([(i, [float(i), 0.0], i % 2) for i in range(8)], "id long, features array<double>, label int")
    near = neighbours.nearest(rows, rows.where("id = 3").select("id", "features"), 3).orderBy("rank").collect()
    assert [(r["id"], r["distance"]) for r in near] == [(3, 0.0), (2, 1.0), (4, 1.0)]
    assert neighbours.vote_by_distance(neighbours.nearest(rows, rows.where("id = 3").select("id", "features"), 3)).first()["predicted"] == 1
    votes = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b"), (2, "b"), (2, "a")], "row_id int, predicted string")
    assert {r[0]: r[1] for r in models.hard_vote(votes).collect()} == {1: "a", 2: "b"}


def test_kernel_machine_and_net_learn_circles():
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 2))
    y = np.where((x**2).sum(1) > 1.4, "out", "in")
    assert (models.KernelMachine(x[:200], y[:200], "rbf", 10.0).predict(x[200:]) == y[200:]).mean() > 0.9
    net = models.DenseNet(x[:200], y[:200], x[200:], y[200:], seed=1, epochs=60)
    assert (net.predict(x[200:]) == y[200:]).mean() > 0.85 and len(net.history) <= 60


def test_audit_of_nothing(spark):
    long = spark.createDataFrame([], "scenario string, row_id int, feature string, raw string, split string")
    assert audit.audit_features(long).count() == audit.audit_outliers(long).count() == audit.audit_examples(long).count() == 0


@pytest.mark.parametrize(("a", "b", "column", "same"), [("1", "1.9", "label", True), ("-1.5", "-1", "label", True), ("x", "X ", "label", False), ("1.2", "1.9", "ClassName", False), ("Lung ", "lung", "ClassName", True), (None, "", "label", True)])
def test_tolerant_equality(spark, a, b, column, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(K.tolerant_equal(F.col("a"), F.col("b"), column)).first()[0] is same


def test_mismatches_of_other_columns_than_the_label(spark):
    t = spark.createDataFrame([(1, "a.png", "1.2", "1.2"), (2, "b.png", "x", "1")], "row_id int, FileName string, size string, label string")
    r = spark.createDataFrame([("a.png", "1.9", "1.9"), ("b.png", "X", "1.0")], "FileName string, size string, label string")
    assert [x["row_id"] for x in matching.mismatches(t, r, "FileName", "FileName", "size", "row_id").collect()] == [1]
    assert matching.mismatches(t, r, "FileName", "FileName", "label", "row_id").count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 101, 3000])
def test_quantiles_by_brute_force(spark, n, monkeypatch):
    from tilewright.operators import quantiles as Q

    r = np.random.default_rng(n)
    values = np.where(r.random(n) < 0.3, 7.0, r.normal(size=n) * 10.0 ** r.integers(0, 6, n))
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("a", None), ("none", None)], "g string, v double")
    want = np.quantile(values, [0.0, 0.25, 0.5, 0.75, 1.0])
    for small in (10**9, 2500):
        monkeypatch.setattr(Q, "SMALL", small)
        got = Q.quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.75, 1.0]).collect()
        assert len(got) == 1 and np.allclose(got[0]["q"], want, rtol=1e-12)


def test_neighbours_without_the_query_itself(spark):
    rows = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(10)] + [(20, [5.0, 5.0], 1)], "id long, features array<double>, label int")
    near = neighbours.nearest(rows, rows.where("id in (9, 20)").select("id", "features"), 5, itself=False).collect()
    assert sorted(x["id"] for x in near if x["query"] == 9) == [0, 1, 2, 3, 4] and all(x["id"] != x["query"] for x in near)


def test_neighbours_by_brute_force(spark):
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(400, 5)), 1)
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, features array<double>, label int").repartition(3)
    got = {}
    for y in neighbours.nearest(rows, rows.where("id < 40").select("id", "features"), 7).collect():
        got.setdefault(y["query"], []).append((y["rank"], y["id"]))
    for q in range(40):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert [i for _, i in sorted(got[q])] == sorted(range(400), key=lambda i: (d[i], i))[:7]


def test_groups_with_a_long_common_beginning_are_numbered_in_order(spark):
    import hashlib

    names = [f"a common beginning of groups {i}" for i in range(50)]
    rows = spark.createDataFrame([(n,) for n in names], "g string")
    got = {r["g"]: r["i"] for r in bootstrap._numbered(rows, "g").collect()}
    assert got == {n: i for i, n in enumerate(sorted(names, key=lambda n: hashlib.md5(n.encode()).hexdigest()))}


def test_bootstrap_of_rows_and_areas(spark):
    r = np.random.default_rng(4)
    truth = r.integers(0, 2, 60)
    score = truth * 0.5 + r.normal(size=60)
    rows = spark.createDataFrame([(i, int(t), int(s > 0.3), [float(-s), float(s)]) for i, (t, s) in enumerate(zip(truth, score))], "row_id int, t int, p int, s array<double>")
    rows = bootstrap.with_row_groups(rows, "row_id")
    draws = bootstrap.numpy_draws(rows, "group", 20)
    got = {x["draw"]: x for x in bootstrap.distribution(rows, "t", "p", "group", draws, "s", [0, 1]).collect()}
    names, g = sorted(map(str, range(60))), np.random.default_rng(bootstrap.SEED)
    for d in range(20):
        at = np.array([int(names[i]) for i in g.choice(60, 60, replace=True)])
        pos, neg = score[at][truth[at] == 1], score[at][truth[at] == 0]
        area = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert got[d]["macro_auc"] == pytest.approx(area) and got[d]["accuracy"] == pytest.approx(((score[at] > 0.3) == truth[at]).mean())


def test_every_preset_can_be_fitted(spark):
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(40, 3)) + 2 * np.array(c) for c in ((1, 0, 0), (0, 1, 0), (0, 0, 1))])
    rows = spark.createDataFrame([(i, v.tolist(), "abc"[i // 40]) for i, v in enumerate(x)], "row_id int, features array<double>, label string")
    fits = {"forest": models.fit_forest, "tree": models.fit_tree, "logistic": models.fit_logistic, "sgd": models.fit_sgd}
    for name, fit in fits.items():
        for params in ([*models.TUNING[name]] if name != "forest" else [p | {"trees": 20} for p in models.TUNING[name]]):
            got = models.predict(fit(rows, **params), rows).where("label = predicted").count()
            assert got > 80
    assert set(models.TUNING) == set(models.SCREENING) == set(models.VARIANT)


def test_modified_huber_is_at_its_optimum(spark):
    r = np.random.default_rng(8)
    x, y = r.normal(size=(200, 4)), r.integers(0, 3, 200)
    rows = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y)], "features array<double>, label int")
    m = models.fit_sgd(rows, 1e-2, "modified_huber", balanced=False)
    one = np.column_stack([x, np.ones(200)])
    for k, w in enumerate(m.w):
        sign = np.where(y == k, 1.0, -1.0)
        z = sign * (one @ w)
        slope = np.where(z >= -1, -2 * np.maximum(0, 1 - z), -4.0) * sign
        grad = (slope[:, None] * one).mean(axis=0) + 1e-2 * np.append(w[:-1], 0)
        assert np.abs(grad).max() < 1e-3


def test_report_order_and_tuned_rows(spark):
    rows = spark.createDataFrame([("Five_Class", 1), ("Binary", 2), ("Three_Class", 3), ("Other", 4)], "scenario string, x int")
    assert [x["x"] for x in selection.in_scenario_order(rows).collect()] == [2, 3, 1]
    with pytest.raises(ContractError):
        selection.in_scenario_order(rows.where("x != 2"))
    led = spark.createDataFrame([("Screening", "Completed"), (" Tuning", "Failed")], "stage string, status string")
    with pytest.raises(ContractError):
        ledger.tuned(led)


def test_preparation_from_raw_text(spark):
    raw = ["1", None, " ", "x", "inf", "-inf", "-3", "9"]
    long = spark.createDataFrame([("s", i, f, p, v, "Train") for p, f in enumerate(("gap", "Cronbach_1")) for i, v in enumerate(raw)], "scenario string, row_id int, feature string, pos int, raw string, split string")
    c = preparation.coerce(long)
    got = {(x["feature"], x["row_id"]): (x["value"], x["became_null"]) for x in c.collect()}
    assert [got["gap", i][1] for i in range(8)] == [None, None, None, "non_numeric", "positive_inf", "negative_inf", "invalid_negative", None]
    assert got["Cronbach_1", 6] == (-3.0, None) and got["gap", 6][0] is None
    assert preparation.coercion_counts(c).first().asDict() == {"scenario": "s", "split": "Train", "non_numeric": 2, "positive_inf": 2, "negative_inf": 2, "invalid_negative": 1}
    p = {x["feature"]: x for x in preparation.fit(c).collect()}
    assert (p["gap"]["median"], p["gap"]["missing"], p["gap"]["q1"], p["gap"]["q3"]) == (5.0, 6, 5.0, 5.0)


def test_screening_then_tuning(spark):
    r = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(90):
        y = i % 2
        labels.append((i, y))
        for p, f in enumerate(("a", "b", "c")):
            v = float(r.normal() + (2.5 * y if p < 2 else 0))
            rows.append(("s", i, f, p, v, "Train" if i < 60 else "Validation" if i < 80 else "Test"))
    long = spark.createDataFrame(rows, "scenario string, row_id long, feature string, pos int, value double, split string")
    prepared = preparation.transform(long, preparation.frozen(preparation.fit(long))).cache()
    labels = spark.createDataFrame(labels, "row_id long, label int")
    lists = spark.createDataFrame([("s", "m", 2, 1, "a"), ("s", "m", 2, 2, "b"), ("s", "AllMsr", 3, 1, "a"), ("s", "AllMsr", 3, 2, "b"), ("s", "AllMsr", 3, 3, "c")], "scenario string, method string, k int, rank int, feature string")
    names = ["gnb", "knn", "tree"]
    with pytest.raises(ContractError, match="screening"):
        flow.run_stage("Tuning", prepared, labels, lists, flow.run_stage("Screening", prepared, labels, lists, None, "s", ["gnb"]), "s", names)
    led = flow.run_stage("Screening", prepared, labels, lists, None, "s", names).cache()
    got = led.collect()
    assert len(got) == 6 and {x["status"] for x in got} == {"Completed"} and min(x["accuracy"] for x in got) > 0.75
    again = flow.run_stage("Screening", prepared, labels, lists, led, "s", names)
    assert sorted(x["at"] for x in again.collect()) == sorted(x["at"] for x in got)
    tuned = flow.run_stage("Tuning", prepared, labels, lists, led, "s", ["gnb", "tree"], top=1)
    best = ledger.best(ledger.tuned(tuned), ["scenario", "model"]).collect()
    assert tuned.where("stage = 'Tuning'").count() == 8 and {x["model"] for x in best} == {"gnb", "tree"}
    with pytest.raises(ContractError):
        flow.answer(prepared, labels, ["a", "nowhere"], "gnb", models.SCREENING["gnb"])


@pytest.mark.parametrize("model", ["svm_rbf", "svm_poly", "logistic", "sgd", "vote"])
def test_other_models_of_the_flow(spark, model, monkeypatch):
    r = np.random.default_rng(10)
    rows = [("s", i, f, p, float(r.normal() + 3 * (i % 2) * (p == 0)), "Train" if i < 40 else "Validation") for i in range(60) for p, f in enumerate("ab")]
    long = spark.createDataFrame(rows, "scenario string, row_id long, feature string, pos int, value double, split string")
    prepared = preparation.transform(long, preparation.frozen(preparation.fit(long)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "row_id long, label int")
    vote = models.vote
    monkeypatch.setattr(models, "vote", lambda *a: vote(*a, trees=10))
    got = flow.answer(prepared, labels, ["a", "b"], model, models.SCREENING[model]).collect()
    assert sorted(x["row_id"] for x in got) == list(range(40, 60)) and sum(x["label"] == x["predicted"] for x in got) >= 16


def test_reports_and_saved_models(spark, tmp_path):
    h = spark.createDataFrame([("s", e, 1.0 / e, abs(e - 3) + 0.5) for e in range(1, 6)], "scenario string, epoch int, loss double, val_loss double")
    assert [x["epoch"] for x in reports.loss_curves(h, ["scenario"]).where("best").collect()] == [3]
    with pytest.raises(ContractError):
        reports.loss_curves(h.withColumn("loss", F.lit(float("nan"))), ["scenario"])
    cells = {(x["truth"], x["predicted"]): x for x in reports.confusion_cells(spark.createDataFrame([("a", "a", 3), ("a", "b", 1), ("b", "a", 0), ("b", "b", 0)], "truth string, predicted string, n long")).collect()}
    assert cells["a", "a"]["percent"] == 75 and cells["a", "a"]["dark_count"] and not cells["a", "b"]["dark_percent"] and cells["b", "b"]["percent"] == 0
    reports.write_report(spark, f"{tmp_path}/report", {"curves": h}, {"seed": 1})
    assert tables.read_table(spark, f"{tmp_path}/report/curves.csv").count() == 5 and tables.read_json(spark, f"{tmp_path}/report/settings.json") == {"seed": 1}
    r = np.random.default_rng(0)
    x, y = r.normal(size=(60, 3)), np.array(["u", "v", "w"])[r.integers(0, 3, 60)]
    for name, m in (("k", models.KernelMachine(x, y, "poly", 1.0, 2, 1.0)), ("n", models.DenseNet(x, y, x, y, epochs=3))):
        reports.save_model(spark, m, f"{tmp_path}/{name}.npz")
        assert (reports.load_model(spark, f"{tmp_path}/{name}.npz").predict(x) == m.predict(x)).all()
    rows = spark.createDataFrame([(v.tolist(), k) for v, k in zip(x, y)], "features array<double>, label string")
    m = models.fit_sgd(rows, 1e-2, "modified_huber")
    reports.save_model(spark, m, f"{tmp_path}/h.npz")
    again = reports.load_model(spark, f"{tmp_path}/h.npz")
    assert models.predict(again, rows).collect() == models.predict(m, rows).collect()


def test_shapes_files_and_names(spark, tmp_path):
    rows = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "features array<double>")
    tables.require_shape(rows, ["a", "b"], rows)
    for names, metadata in ((["a"], None), (["a", "a"], None), (["a", "b"], rows.limit(1))):
        with pytest.raises(ContractError):
            tables.require_shape(rows, names, metadata)
    with pytest.raises(ContractError):
        tables.require_files(spark, [f"{tmp_path}/nothing"])
    names = spark.createDataFrame([("A.png", "x"), ("b.png", "y"), ("B.PNG", "z")], "FileName string, ClassName string")
    got = matching.with_names(spark.createDataFrame([("a.png",), ("b.png",), (None,)], "FileName string"), names, "FileName", "ClassName")
    assert {x["FileName"]: x["ClassName"] for x in got.collect()} == {"a.png": "x", "b.png": None, None: None}


def test_a_forest_is_grown_until_its_leaves_are_pure(spark):
    """200 values whose classes alternate: Spark's 32 bins can't tell them apart."""
    rows = spark.createDataFrame([(i, [float(i), 0.0], "ab"[i % 2]) for i in range(200)], "row_id int, features array<double>, label string")
    model = models.fit_forest(rows, trees=40, subset="all")
    assert models.predict(model, rows).where("label = predicted").count() >= 190
    assert models.importances(model) == pytest.approx([1.0, 0.0])
    a, b = (models.predict(models.fit_forest(x, trees=5, subset="all"), rows).orderBy("row_id").collect() for x in (rows, rows.repartition(7)))
    assert a == b


def test_a_tree_takes_the_best_split():
    from tilewright.operators import forest

    r = np.random.default_rng(3)
    for leaf in (1, 5):
        x, y, w = r.integers(0, 9, (60, 4)).astype(np.uint8), r.integers(0, 3, 60), r.random(60) + 0.5
        count = r.poisson(1.0, 60)

        def loss(at):
            t = np.bincount(y[at], (w * count)[at], 3)
            return (t**2).sum() / max(t.sum(), 1e-300)

        found = {(f, c): loss(x[:, f] <= c) + loss(x[:, f] > c) for f in range(4) for c in range(9) if min(count[x[:, f] <= c].sum(), count[x[:, f] > c].sum()) >= leaf}
        tree, gain = forest.grow(x, y, w, count, 3, 4, 1, leaf, r)
        assert found[int(tree[0][0]), int(tree[1][0])] == pytest.approx(max(found.values()))
        assert gain.sum() == pytest.approx(max(found.values()) - loss(np.full(60, True)))
        s = forest.scores(forest.grow(x, y, w, count, 3, 4, None, 1, r)[0], x, 3)
        same = {tuple(v) for v in x[count > 0].tolist()}
        for v in same:
            at = (x == v).all(axis=1) & (count > 0)
            if len(set(y[at])) == 1:
                assert s[at].argmax(axis=1).tolist() == y[at].tolist()


@pytest.mark.parametrize("params", [("rbf", 10.0), ("poly", 1.0, 3, 0.0), ("poly", 10.0, 2, 1.0)])
def test_more_rows_than_a_kernel_matrix_may_have(monkeypatch, params):
    r = np.random.default_rng(12)
    x, y = r.normal(size=(300, 8)), r.integers(0, 4, 300).astype(str)
    whole = models.KernelMachine(x, y, *params)
    monkeypatch.setattr(models, "MOST_ROWS", 100)
    monkeypatch.setattr(models, "BLOCK_CELLS", 300 * 77)
    blocks = models.KernelMachine(x, y, *params)
    assert np.abs(blocks.scores(x[:150]) - whole.scores(x[:150])).max() < 1e-6
    assert len(models.DenseNet(x, y, x, y, epochs=1).history) == 1


def test_kernel_machines_of_many_rows_take_few_steps_in_many_tasks(spark, monkeypatch):
    """Beyond MOST_ROWS the answers are those of the whole matrix, after a few steps, each made by many tasks."""
    r = np.random.default_rng(8)
    x = r.normal(size=(900, 20)) + 0.5 * r.normal(size=(4, 20))[np.arange(900) % 4]
    data = [(k, int(k % 4), x[k].tolist(), "Validation" if k % 5 == 0 else "Train") for k in range(900)]
    rows = spark.createDataFrame(data, "row_id long, label int, features array<double>, split string")
    configs = [{"name": "rbf", "model": "svm_rbf", "c": 10.0}, {"name": "poly", "model": "svm_poly", "c": 1.0, "degree": 3, "coef0": 0.0}, {"name": "net", "model": "net", "seed": 42, "epochs": 2}]
    want = sorted(map(tuple, models.run_bounded(rows, configs).collect()))
    monkeypatch.setattr(models, "MOST_ROWS", 100)
    monkeypatch.setattr(models, "TILE", 64)
    made, solve = [], models.KernelMachine
    monkeypatch.setattr(models, "KernelMachine", lambda *a, **k: made.append(solve(*a, **k)) or made[-1])
    assert sorted(map(tuple, models.run_bounded(rows, configs).collect())) == want
    assert len(want) == 3 * 180 and [m.steps > 0 for m in made] == [True, True] and max(m.steps for m in made) < 45
