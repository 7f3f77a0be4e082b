import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions import similarity as S
from kinfold.operators import blocking, decide, features, folds, metrics, ml, stats
from kinfold.plans import linkage
from kinfold.sources import records, sinks
from kinfold.streaming.linkage import stream_candidates


def test_f05_table(spark):
    rows = [(2, 3, 2, 0.714286), (3, 3, 3, 1.0), (2, 2, 3, 0.909091), (3, 4, 3, 0.789474), (2, 3, 3, 0.666667), (0, 0, 0, 1.0), (0, 0, 4, 0.0), (0, 4, 0, 0.0), (0, 3, 2, 0.0)]
    df = spark.createDataFrame(rows, "tp int, k int, n int, want double")
    assert df.select(F.round(decide.f05(F.col("tp"), F.col("k"), F.col("n")), 6) == F.col("want")).distinct().collect() == [(True,)]


def test_smape_examples(spark):
    for t, p, want in [(100, 120, 18.1818), (100, 200, 66.6667), (0, 0, 0), (0, 1, 200), (100, 150, 40), (100, 50, 66.67)]:
        got = metrics.score(spark.createDataFrame([(float(t), float(p))], "t double, p double"), "smape", "t", "p").first()[0]
        assert got == pytest.approx(want, abs=0.01)
    assert metrics.is_better("smape", 1, 2) and metrics.is_better("f1_macro", 2, 1)


def test_assignment_is_the_greedy_one(spark):
    rng = random.Random(1)
    pairs = [(f"a{i}", f"b{j}", rng.choice([0.2, 0.5, 0.9])) for i in range(12) for j in range(8) if rng.random() < 0.6]
    seen, want = set(), set()
    for s, c, p in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
        if c not in seen:
            seen.add(c)
            want.add((s, c))
    got = decide.apply_assignment(spark.createDataFrame(pairs, "s1_id string, cand_id string, prob double"))
    assert {(r.s1_id, r.cand_id) for r in got.collect()} == want


def test_candidate_invariants(spark, sf_small):
    from kinfold.plans import linkage

    n, c = linkage._cands(spark, sf_small, "parts")
    top = blocking.rescore_and_cut(c, n, 5)
    assert top.groupBy("s1_id", "source").count().agg(F.max("count")).first()[0] <= 5
    assert top.agg(F.min("nkeys"), F.min("blk_sim"), F.max("blk_sim")).first()[0] >= 1
    assert {tuple(r) for r in c.repartition(7).select("s1_id", "cand_id", "nkeys").collect()} == {tuple(r) for r in linkage._cands(spark, sf_small, "parts")[1].select("s1_id", "cand_id", "nkeys").collect()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_never_dealt_by_their_texts(spark):
    records = spark.createDataFrame([("S1_1", "a b", "1 x"), ("S1_2", "a b", "1 x"), ("S2_1", "b a", "1 x"), ("S2_2", "a b", "1 x"), ("S3_1", "", "")], "entity_id string, name_n string, addr_n string")
    pairs = spark.createDataFrame([(s, c, int(c[1]), 1) for s in ("S1_1", "S1_2") for c in ("S2_1", "S2_2", "S3_1")], "s1_id string, cand_id string, source int, nkeys int")
    top = blocking.rescore_and_cut(pairs, records, 1)
    assert "hashpartitioning(n1" not in plan(top) and plan(top).count("blk_sim") and plan(top).count("ArrowEvalPython ") == 1
    assert {(r.s1_id, r.cand_id, round(r.blk_sim, 6)) for r in top.collect()} == {(s, c, x) for s in ("S1_1", "S1_2") for c, x in (("S2_2", 100.0), ("S3_1", round(30 * S.partial("a b 1 x", " "), 6)))}


def test_features_of_a_pair_move_once_by_each_side(spark):
    rows = [("S1_1", 1, "a b", "1 x"), ("S1_2", 1, "a b", "2 x"), ("S2_1", 2, "b a", "1 x"), ("S2_2", 2, "a b", "1 x"), ("S3_1", 3, "", "")]
    records = spark.createDataFrame([(*r, "X", "1", "1", "", 0) for r in rows], "entity_id string, source int, name_n string, addr_n string, country string, addr_digits string, addr_house string, addr_pin string, was_nonascii int")
    pairs = spark.createDataFrame([(s, c, int(c[1]), "X", 1) for s in ("S1_1", "S1_2") for c in ("S2_1", "S2_2", "S3_1")], "s1_id string, cand_id string, source int, country string, nkeys int")
    out = features.build_features(pairs, records, stats.idf(records))
    assert "hashpartitioning(name_n" not in plan(out) and plan(out).count("compute(name_n_1") == 1 and "InMemoryTableScan" in plan(out)
    text = {r[0]: r[2:4] for r in rows}
    got = {(r.s1_id, r.cand_id): r for r in out.collect()}
    assert len(got) == 6 and list(out.columns[:5]) == ["s1_id", "cand_id", "source", "country", "nkeys"]
    for (one, two), r in got.items():
        (n1, a1), (n2, a2) = text[one], text[two]
        assert (r.nm_tset, r.ad_tset, r.nm_tsort, r.ad_ratio, r.nm_jw) == (S.token_set(n1, n2), S.token_set(a1, a2), S.token_sort(n1, n2), S.ratio(a1, a2), S.jaro_winkler(n1, n2))
        assert (r.x_nm1_ad2, r.x_nm2_ad1, r.ad_part) == (S.partial(n1, a2), S.partial(n2, a1), S.partial(a1, a2)) and r.base == r.ad_tset + r.nm_tset + r.ad_idf_ov


def test_records_truth_and_lists(spark, tmp_path):
    (tmp_path / "r.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1_1\tNA\t\tUS\nS2_1\t"a ""b"""\tx\tIN\n')
    r = records.with_source(records.read_records(spark, str(tmp_path / "r.tsv"))).orderBy("entity_id").collect()
    assert [(x.business_name, x.business_address, x.source) for x in r] == [("NA", "", 1), ('a "b"', "x", 2)]
    assert records.read_records(spark, str(tmp_path / "r.tsv"), "IN", ("entity_id",)).collect() == [("S2_1",)]
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1_1\tS2_1, S3_2,,S2_1\nS1_2\t\n")
    truth = records.read_truth(spark, str(tmp_path / "t.tsv"))
    assert {tuple(x) for x in truth.collect()} == {("S1_1", "S2_1"), ("S1_1", "S3_2")}
    ids = spark.createDataFrame([("S1_2", 0), ("S1_1", 1)], "s1_id string, place int")
    assert {tuple(x) for x in records.truth_sets(ids.select("s1_id"), truth).collect()} == {("S1_1", 2), ("S1_2", 0)}
    ranked = spark.createDataFrame([("S1_1", "S3_2", 2), ("S1_1", "S2_1", 1), ("S1_1", "S2_1", 3)], "s1_id string, cand_id string, rank int")
    sinks.write_lists(sinks.listed(ids, ranked), str(tmp_path / "out"))
    text = "".join(sorted(p.read_text() for p in (tmp_path / "out").glob("*.csv")))
    assert "S1_1\tS2_1,S3_2" in text and text.index("S1_2") < text.index("S1_1")


def test_validated_output_rejects(spark):
    make = lambda rows: spark.createDataFrame(rows, "id int, y double")
    sample = make([(2, 0.0), (1, 0.0)])
    out = sinks.validated(make([(1, -3.0), (2, 99.6)]), "id", "y", sample, 0, 50, whole=True)
    assert {tuple(r) for r in out.collect()} == {(1, 0.0), (2, 50.0)}
    for bad in ([(1, float("nan")), (2, 1.0)], [(1, float("inf")), (2, 1.0)], [(1, 1.0), (1, 2.0)], [(1, 1.0), (3, 2.0)], [(1, 1.0)]):
        with pytest.raises(ValueError):
            sinks.validated(make(bad), "id", "y", sample)
    assert sinks.report(out, "y").first()["median"] == 25.0


def test_cached_csv_and_partial_rewrites(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"p\nq"\n300,z\n')
    one = records.load_cached(spark, str(tmp_path / "x.csv"))
    (tmp_path / "x.csv").unlink()
    two = records.load_cached(spark, str(tmp_path / "x.csv"))
    assert one.collect() == two.collect() and dict(two.dtypes)["a"] == "smallint" and two.count() == 2
    for rows in ([("US", 1), ("IN", 2)], [("IN", 3)]):
        sinks.write_by_country(spark.createDataFrame(rows, "country string, v int"), str(tmp_path / "c"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "c")).select("country", "v").collect()} == {("US", 1), ("IN", 3)}


def test_images(spark, tmp_path):
    calls = []

    def fetch(url):
        calls.append(url)
        return (404, b"") if "gone" in url else (200, b"img")

    urls = spark.createDataFrame([("http://h/a.jpg",), ("http://h/gone.jpg",), ("http://h/",), (None,), ("http://h/a.jpg",)], "url string")
    got = {r.url: r.status for r in records.fetch_images(urls, str(tmp_path / "i"), fetch, pause=0).collect()}
    assert got == {"http://h/a.jpg": "ok", "http://h/gone.jpg": "fail", "http://h/": "skip"}
    again = records.fetch_images(urls, str(tmp_path / "i"), fetch, pause=0)
    assert {r.status: r.n for r in records.status_counts(again).collect()} == {"cached": 1, "fail": 1, "skip": 1}


def test_folds_cv_and_blend(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("y"), (F.col("id") % 3).alias("g"))
    for strategy, column in (("kfold", None), ("stratified", "g"), ("group", "g")):
        f = folds.make_folds(df, "id", 5, strategy, column)
        assert f.where("fold is null or fold < 0 or fold > 4").count() == 0
    assert folds.make_folds(df, "id", 5, "group", "g").groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    fit = lambda train, rows, fold: rows.crossJoin(train.agg(F.avg("y").alias("prediction")))
    oof, scores, test = folds.run_cv(folds.make_folds(df, "id"), "id", "y", fit, lambda d: metrics.score(d, "rmse", "y", "prediction").first()[0], test=df.limit(3))
    assert oof.count() == 200 and len(scores) == 5 and test.count() == 3
    with pytest.raises(Exception, match="differ"):
        folds.blend([df.select("id", "y"), df.where("id < 9").select("id", "y")], [1, 1], "id", "y").collect()


def test_isotonic_is_monotone_and_band_hook(spark):
    import numpy as np

    rows = [(i, (i % 100) / 100, int((i * 37) % 100 < i % 100)) for i in range(600)]
    out = ml.calibrate(spark.createDataFrame(rows, "id long, prob double, label int"), "id").orderBy("prob").select("calibrated").toPandas()["calibrated"].to_numpy()
    assert (np.diff(out) >= -1e-9).all() and out.min() >= 0 and out.max() <= 1
    pairs = spark.createDataFrame([("a", "b", 0.5, "xx", "yyy"), ("a", "c", 0.99, "x", "y")], "s1_id string, cand_id string, prob double, text1 string, text2 string")

    def scorer():
        return lambda a, b: np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], float)

    assert [tuple(r) for r in ml.score_band(pairs, scorer).collect()] == [("a", "b", 5.0)]


def test_streamed_records_meet_the_index(spark, tmp_path):
    keys = spark.createDataFrame([("S1_1", "US", "n|x"), ("S1_2", "US", "n|y")], "entity_id string, country string, key string")
    keys.write.parquet(str(tmp_path / "in"))
    index = spark.createDataFrame([("S2_9", "US", "n|x"), ("S3_9", "IN", "n|x")], "entity_id string, country string, key string")
    stream = spark.readStream.schema(keys.schema).parquet(str(tmp_path / "in"))
    q = stream_candidates(stream, index).writeStream.format("memory").queryName("linked").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("linked").collect()] == [("S1_1", "S2_9", "n|x")]


def test_text_regression_gives_every_document_a_prediction(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").where("text is not null")
    got = [r.doc_id for r in linkage.queries()["text_regression"](spark, sf_small).collect()]
    assert sorted(got) == sorted(r.doc_id for r in docs.collect())


def test_discovery_shards_and_cache(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "train_source1.tsv").write_text("x\n")
    (tmp_path / "c").mkdir()
    assert records.discover(spark, [f"{tmp_path}/none*", f"{tmp_path}/*"]).endswith("/a")
    assert records.discover(spark, [f"{tmp_path}/c"], default="d") == "d"
    spark.range(5).repartition(2).write.parquet(f"{tmp_path}/shards")
    assert records.read_shards(spark, f"{tmp_path}/shards").count() == 5
    assert records.read_shards(spark, f"{tmp_path}/nowhere", f"{tmp_path}/shards").count() == 5 and records.read_shards(spark, f"{tmp_path}/nowhere") is None
    (tmp_path / "t.csv").write_text('a,b\n1,"x, ""y"""\n300,z\n')
    for _ in range(2):
        t = records.load_cached(spark, f"{tmp_path}/t.csv")
        assert {tuple(r) for r in t.collect()} == {(1, 'x, "y"'), (300, "z")} and t.schema["a"].dataType.simpleString() == "smallint"
    assert not list(tmp_path.glob("*.part"))


def test_images_are_converted_and_failures_kept(spark, tmp_path):
    def fetch(url):
        return (200, url.encode()) if "good" in url else (404, b"")

    def convert(body):
        if b"bad" in body:
            raise ValueError("no image")
        return b"J" + body

    urls = spark.createDataFrame([("http://x/good1.png",), ("http://x/gone",), ("http://x/good-bad",), ("http://x/",)], "url string")
    got = {r.url: (r.status, r.reason) for r in records.fetch_images(urls, str(tmp_path / "i"), fetch, pause=0.0, convert=convert).collect()}
    assert got == {"http://x/good1.png": ("ok", ""), "http://x/gone": ("fail", "status 404"), "http://x/good-bad": ("fail", "not an image: no image"), "http://x/": ("skip", "no file name")}
    assert (tmp_path / "i" / "good1.png.jpg").read_bytes() == b"Jhttp://x/good1.png"
    plain = records.fetch_plainly(urls, str(tmp_path / "p"), fetch)
    records.write_failures(plain, str(tmp_path / "failed"))
    assert "".join(p.read_text() for p in (tmp_path / "failed").glob("*.csv")) == "http://x/gone\tstatus 404\n"
    listing = spark.createDataFrame([("good1.png.jpg",)], "name string")
    assert {r.url: r.path for r in records.attach_paths(urls, listing, "/i", resized=True).collect()}["http://x/good1.png"] == "/i/good1.png.jpg"


def test_sinks_write(spark, tmp_path):
    p = spark.createDataFrame([(2, 7.6), (1, 0.2)], "id long, price double")
    told = sinks.write_validated(p, str(tmp_path / "out"), "id", "price", p, "gzip", clip_min=1.0, whole=True).first()
    assert (told["min"], told["max"]) == (1.0, 8.0) and list((tmp_path / told["path"].rsplit("/", 1)[1]).glob("*.csv.gz"))
    assert spark.read.csv(told["path"], header=True, inferSchema=True).orderBy("id").collect() == [(1, 1.0), (2, 8.0)]
    pairs = spark.createDataFrame([("S1_1", "S2_1", "US", 2), ("S1_1", "S3_1", "IN", 3)], "s1_id string, cand_id string, country string, source int")
    sinks.write_shards(pairs, str(tmp_path / "shards"))
    assert (tmp_path / "shards" / "country=US" / "source=2").is_dir() and spark.read.parquet(str(tmp_path / "shards")).count() == 2
    d = spark.createDataFrame([("S1_1", "one"), ("S2_1", "two"), ("S3_1", "three")], "entity_id string, text string")
    assert {tuple(r)[2:] for r in sinks.labelled_pairs(pairs, d, pairs.where("source = 3")).collect()} == {("one", "two", 0), ("one", "three", 1)}
    sinks.save_run(str(tmp_path / "run"), oof=p)
    assert spark.read.parquet(str(tmp_path / "run" / "oof")).count() == 2


def test_places_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1.0, 2.5, rng.random() * 9, -3.0])) for i in range(700)]
    got = {r.id: r.place for r in folds.ranked_by(spark.createDataFrame(rows, "id long, v double").repartition(5), "v", "id").collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    assert [got[i] for i, _ in want] == list(range(700))
    assert folds.ranked_by(spark.createDataFrame([], "id long, v double"), "v", "id").count() == 0


def test_hooks_and_stability():
    import numpy as np

    assert folds.unstable([1.0, 2.0]) and not folds.unstable([1.0, 1.1])
    name, value, greater = metrics.eval_hook("smape")(np.array([120.0, 0.0]), np.array([100.0, 0.0]))
    assert (name, greater) == ("smape", False) and value == pytest.approx(9.0909, abs=1e-3)


def test_environment(spark):
    from kinfold.operators import stats

    assert {r.check for r in stats.environment(spark).where("ok").collect()} >= {"spark", "numpy", "arrow round trip"}


def test_words_move_as_packed_numbers(spark):
    """Common, unseen and repeated words, empty fields, records without a row; sums by hand."""
    from kinfold.operators import features

    records_ = spark.createDataFrame([("a", "X", "acme zed zed", "1 main st"), ("b", "X", "acme new", "main st st 2"), ("c", "X", "", ""), ("d", "X", "zed main", "")], "entity_id string, country string, name_n string, addr_n string")
    idf = spark.createDataFrame([("X", "acme", 1.5), ("X", "main", 0.25), ("X", "st", 0.0), ("Y", "zed", 3.0)], "country string, token string, idf double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "c"), ("a", "d"), ("a", "none")], "s1_id string, cand_id string")
    got = {(r.s1_id, r.cand_id): (r.ad, r.ad_all, r.nm, r.nm_all) for r in features.shared_weights(pairs, records_, idf).collect()}
    m = 1_000_000
    assert got == {
        ("a", "b"): (m // 4, 16 * m + m // 4, 3 * m // 2, 17 * m + m // 2), ("a", "c"): (0, 8 * m + m // 4, 0, 9 * m + m // 2), ("c", "c"): (0, 0, 0, 0),
        ("a", "d"): (0, 8 * m + m // 4, 8 * m, 9 * m + m // 2 + m // 4), ("a", "none"): (0, 8 * m + m // 4, 0, 9 * m + m // 2),
    }


def test_texts_do_not_move_with_pairs(spark, sf_small):
    """Of two texts at most one is in an exchange with a pair; overlaps and structure move no text, and words once."""
    from kinfold.operators import features, stats
    from kinfold.plans import adapters

    n = adapters.normalized(adapters.part_records(spark, sf_small)).select("entity_id", "source", "country", "name_n", "addr_n", "addr_digits", "addr_house", "addr_pin", "was_nonascii")
    n = spark.createDataFrame(n.limit(30).toPandas())
    ids = n.select("entity_id")
    pairs = ids.withColumnRenamed("entity_id", "s1_id").crossJoin(ids.withColumnRenamed("entity_id", "cand_id"))
    dictionary = n.select("entity_id", F.col("name_n").alias("text"))

    def moved(df):
        """Columns of what each exchange moves."""
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found, todo = [], [df.select("*")._jdf.queryExecution().executedPlan().initialPlan()]
        while todo:
            node = todo.pop()
            if "Exchange" in node.nodeName():
                found.append({node.output().apply(i).name() for i in range(node.output().size())})
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return found

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        labelled = moved(sinks.labelled_pairs(pairs, dictionary, pairs.limit(3)))
        assert labelled and not any({"text1", "text2"} <= x for x in labelled)
        shape = moved(features.structured_pairs(pairs, n))
        assert shape and not any({"s1_id", "cand_id"} <= x and "addr_n_1" in x and dict(features.structured_pairs(pairs, n).dtypes)["addr_n_1"] == "string" for x in shape)
        words = moved(features.idf_overlap(pairs, n, stats.idf(n)))
        assert not any({"ad_1", "nm_1"} & x for x in words)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.catalog.clearCache()


def test_grams_are_never_broadcast(spark, sf_small):
    texts = spark.read.parquet(f"{sf_small}/part.parquet").selectExpr("cast(p_partkey as string) as id", "1 + int(p_partkey % 2) as group", "p_name as text")
    plan = blocking.tfidf_vectors(texts, F.col("group") == 2)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin [gram" in plan


def test_neighbours_of_repeated_texts(spark, monkeypatch):
    """Equal to all products of the vectors, over copies, repeated ids, words without grams of the vocabulary, several blocks and chunks."""
    rng = np.random.default_rng(3)
    words = ["large", "ring", "old", "plate", "brand", "7", "12", "56001", "größe", "x", "q9"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 6))) for _ in range(60)]
    rows = [(f"S{i}", 1 + i % 2, texts[int(rng.integers(60))]) for i in range(400)] + [("S7", 2, "old plate"), ("E", 1, ""), ("F", 1, "zz")]
    df = spark.createDataFrame(rows, "id string, group int, text string")
    grams = df.select("text", blocking.char_wb_grams(F.col("text")).alias("g")).collect()
    assert all(sorted(r.g) == sorted(g for w in r.text.split(" ") if w for g in blocking.word_grams(w)) for r in grams)
    v = blocking.tfidf_vectors(df, F.col("group") == 2)
    a, b = v.where("group = 1").select("gram", F.col("id").alias("s1_id"), F.col("w").alias("a")), v.where("group = 2").select("gram", F.col("id").alias("cand_id"), F.col("w").alias("b"))
    sims = a.join(b, "gram").groupBy("s1_id", "cand_id").agg(F.sum(F.col("a") * F.col("b")).alias("sim")).where("sim > 0.2").toPandas()
    sims = sims.assign(r=sims["sim"].round(9)).sort_values(["s1_id", "r", "cand_id"], ascending=[True, False, True]).groupby("s1_id").head(30)
    for name, value in (("BLOCK", 16), ("QUERIES", 8), ("ROWS", 16)):
        monkeypatch.setattr(blocking, name, value)
    out = blocking.tfidf_neighbours(df)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "gram" not in plan
    got = out.toPandas()
    assert sorted(zip(got["s1_id"], got["cand_id"], got["sim"].round(6), strict=True)) == sorted(zip(sims["s1_id"], sims["cand_id"], sims["sim"].round(6), strict=True))


def test_labelled_pairs_move_no_text(spark):
    """A text goes once to each part: repeated ids, null texts and ids without a record as in a join, and no exchange of pairs with texts."""
    d = spark.createDataFrame([("a", "one"), ("b", "zwei, größer"), ("b", "two"), ("c", None), ("d", ""), (None, "none")], "entity_id string, text string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("b", "d"), ("b", "b"), ("c", "a"), ("x", "a"), ("a", "x"), (None, "a")], "s1_id string, cand_id string")
    truth = spark.createDataFrame([("a", "b"), ("b", "d")], "s1_id string, cand_id string")
    texts = {k: [r.text for r in d.collect() if r.entity_id == k] for k in "abcdx"}
    want = sorted(repr((s, c, x, y, int((s, c) in {("a", "b"), ("b", "d")}))) for s, c in map(tuple, pairs.collect()) if s for x in texts[s] for y in texts[c])
    out = sinks.labelled_pairs(pairs, d, truth)
    assert sorted(repr(tuple(r)) for r in out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(part" in plan and "Join [cand_id" not in plan
    spark.catalog.clearCache()
