"""Small cases with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from stratamine.functions import hashing, text
from stratamine.operators import cluster, explore, graph, itemsets, recommend, relational, similarity, sketch
from stratamine.sources import readers, writers


@pytest.fixture(scope="module")
def reviews(spark):
    return spark.createDataFrame(
        [("r1", "u1", "b1", 5.0, "2017-01-02", "Great food, great (service)!"), ("r2", "u1", "b2", 3.0, "2017-05-01", "ok food"), ("r3", "u2", "b1", 4.0, "2016-07-09", "The food is great."), ("r4", "u3", "b3", 2.0, "2017-03-03", None), ("r5", "u2", "b2", 1.0, "2018-01-01", "bad\n\nservice")],
        "review_id string, user_id string, business_id string, stars double, date string, text string",
    )


@pytest.fixture(scope="module")
def business(spark):
    rows = spark.createDataFrame([("b1", "Pizza, Bars"), ("b2", "Bars"), ("b3", None), ("b4", "Cafe"), ("b5", "")], "business_id string, categories string")
    return rows.withColumn("names", text.categories(F.col("categories")))


def test_exploration(reviews, business):
    got = explore.review_counts(reviews, 2017, "user_id", "date", F.col("text").isNotNull()).first()
    assert tuple(got) == (5, 3, 2)
    assert [tuple(r) for r in explore.top_keys(reviews, "user_id", 2).collect()] == [("u1", 2), ("u2", 2)]
    words = [tuple(r) for r in explore.top_words(reviews, "text", 9).collect()]
    assert words == [("food", 3), ("great", 3), ("bad\n\nservice", 1), ("ok", 1), ("service", 1)]
    average = lambda **k: [tuple(r) for r in explore.category_average(reviews, business, "business_id", "stars", "names", 9, **k).collect()]
    assert average() == [("Pizza", 4.5), ("Bars", 3.25)]
    assert average(keep_empty=True) == [("Pizza", 4.5), ("Bars", 3.25), ("Cafe", 0.0)]
    assert sorted(map(tuple, explore.more_than(reviews, "business_id", 1).collect())) == [("b1", 2), ("b2", 2)]
    assert [tuple(r) for r in explore.dense_index(reviews, "business_id").orderBy("idx").collect()] == [("b1", 0), ("b2", 1), ("b3", 2)]
    profile = explore.partition_profile(reviews, F.lit(1), 3).orderBy("part").collect()
    assert [tuple(r) for r in profile] == [(0, 0), (1, 5), (2, 0)]


def test_itemsets(spark):
    sets = {1: [1, 2, 3], 2: [1, 2], 3: [2, 3], 4: [1, 2, 3]}
    rows = spark.createDataFrame([(b, i) for b, s in sets.items() for i in s], "basket long, item long")
    want = {(1,): 3, (2,): 4, (3,): 3, (1, 2): 3, (1, 3): 2, (2, 3): 3, (1, 2, 3): 2}
    as_dict = lambda df: {tuple(r["items"]): r["support"] for r in df.collect()}
    found = {}
    for k in (1, 2, 3):
        found |= as_dict(itemsets.frequent(rows, k, 2))
    assert found == want
    assert as_dict(itemsets.by_growth(rows, 2, 4)) == want
    for chunks in (1, 2, 3):
        for most in (3, None):
            candidates = itemsets.chunk_candidates(rows, F.pmod("basket", F.lit(chunks)), 2, most)
            assert as_dict(itemsets.count_candidates(rows, candidates, 2)) == want
    assert as_dict(itemsets.frequent_pairs_by_buckets(rows, 3, 7)) == {(1, 2): 3, (2, 3): 3}
    assert itemsets.baskets(rows, "basket", "item", 2).count() == 2


def test_similarity(spark):
    rows = spark.createDataFrame([("a", x) for x in (1, 2, 3)] + [("b", x) for x in (2, 3, 4)] + [("c", x) for x in (1, 2, 3)], "k string, m long")
    pairs = {(r["k1"], r["k2"]): r["jaccard"] for r in similarity.jaccard_pairs(rows, "k", "m", 0.1).collect()}
    assert pairs == {("a", "b"): 0.5, ("a", "c"): 1.0, ("b", "c"): 0.5}
    assert similarity.jaccard_pairs(rows, "k", "m", 0.01, 3).count() == 1
    s = {(r["k"], r["i"]): r["m"] for r in similarity.signatures(rows, "k", F.col("m"), hashing.family(8)).collect()}
    assert all(s["a", i] == s["c", i] for i in range(8))
    assert ("a", "c") in {(r["k1"], r["k2"]) for r in similarity.banded_pairs(similarity.signatures(rows, "k", F.col("m"), hashing.family(8)), 2).collect()}
    docs = spark.createDataFrame([("d1", "xa xa xb"), ("d2", "xb xc")], "d string, t string")
    tfidf = {(r["k"], r["word"]): r["tfidf"] for r in similarity.profiles(similarity.word_counts(docs, "d", "t"), 2, 9).collect()}
    assert tfidf == {("d1", "xa"): 1.0, ("d1", "xb"): 0.0, ("d2", "xb"): 0.0, ("d2", "xc"): 1.0}
    profile = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "c"), ("q", "d")], "k string, word string")
    visits = spark.createDataFrame([("u", "p"), ("u", "q")], "u string, k string")
    assert {(r["k"], r["cosine"]) for r in similarity.content_cosine(profile, visits, "u", "k", 0.01).collect()} == {("p", 0.707107), ("q", 0.707107)}


def test_recommend(spark):
    rows = [(1, 1, 5.0), (2, 1, 3.0), (3, 1, 1.0), (1, 2, 4.0), (2, 2, 3.0), (3, 2, 2.0), (1, 3, 2.0), (2, 3, 2.0), (3, 3, 2.0), (1, 4, 1.0), (2, 4, 3.0)]
    ratings = recommend.averaged(spark.createDataFrame(rows, "user long, item long, stars double"), "user", "item", "stars")
    assert {(r["k1"], r["k2"]): r["sim"] for r in recommend.pearson_pairs(ratings, "b", "u").collect()} == {(1, 2): 1.0, (1, 3): 0.0, (2, 3): 0.0}
    model = recommend.item_model(ratings)
    assert [tuple(r) for r in model.collect()] == [(1, 2, 1.0)]
    more = recommend.averaged(spark.createDataFrame([*rows, (4, 2, 4.0)], "user long, item long, stars double"), "user", "item", "stars")
    test = spark.createDataFrame([(4, 1)], "u long, b long")
    assert [tuple(r) for r in recommend.item_predictions(test, more, model).collect()] == [(4, 1, 4.0)]
    given = recommend.averaged(spark.createDataFrame([(1, 8, 3.0), (2, 9, 5.0), (2, 7, 2.0), (3, 9, 2.0), (3, 7, 4.0)], "user long, item long, stars double"), "user", "item", "stars")
    near = spark.createDataFrame([(1, 2, 0.5), (1, 3, 1.0)], "k1 long, k2 long, sim double")
    assert [tuple(r) for r in recommend.user_predictions(spark.createDataFrame([(1, 9)], "u long, b long"), given, near).collect()] == [(1, 9, 2.666667)]


def test_graph(spark):
    pairs = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6)]
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src long, dst long")
    between = {(r["a"], r["b"]): r["betweenness"] for r in graph.edge_betweenness(edges).collect()}
    assert between == {(3, 4): 9.0, (1, 3): 4.0, (2, 3): 4.0, (4, 5): 4.0, (4, 6): 4.0, (1, 2): 1.0, (5, 6): 1.0}
    assert graph.modularity(edges, graph.components(edges), "component").first()[0] == 0.0
    found = graph.girvan_newman(edges).collect()
    assert {r["id"]: r["community"] for r in found} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert {r["modularity"] for r in found} == {0.357143}
    none = edges.where("false")
    assert graph.components(none).count() == graph.girvan_newman(none).count() == graph.edge_betweenness(none).count() == 0
    assert graph.mutual(edges).count() == 7
    assert tuple(graph.most_between(graph.edge_betweenness(edges)).first())[:2] == (3, 4)


def test_sketches(spark):
    keys = spark.range(1000).select(F.col("id").alias("k"))
    assert tuple(sketch.bloom_estimate(keys, "k", 10, 10_000).first()) == (1000, 1.0, 0.010186)
    hashes = hashing.family(10, 3)
    positions = sketch.bloom_positions(keys, "k", hashes, 10_000)
    seen = sketch.bloom_probe(spark.range(2000).select(F.col("id").alias("k")), "k", positions, hashes, 10_000)
    assert seen.where("k < 1000 and seen = 0").count() == 0
    assert seen.where("k >= 1000 and seen = 1").count() < 60
    one = spark.range(1)
    fold = lambda t, n: one.select(hashing.byte_fold(F.lit(t), n)).first()[0]
    assert fold("San Francisco", 10_000) == 6847
    assert fold("ab", 255) == fold("ba", 255) == 195
    zeros = {x: one.select(hashing.trailing_zeros(F.lit(x).cast("long"))).first()[0] for x in (12, 0, 128, 7)}
    assert zeros == {12: 2, 0: 1, 128: 7, 7: 0}
    tags = spark.createDataFrame([(t,) for t, n in zip("abcde", (5, 5, 4, 3, 2), strict=True) for _ in range(n)], "tag string")
    assert sorted(r["tag"] for r in sketch.top_frequencies(tags, "tag").collect()) == ["a", "b", "c", "d"]
    assert sketch.sample(keys, "k", 5000).count() == 1000


def test_clusters(spark):
    points = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [3.0, 4.0], 0)], "id long, x array<double>, c int")
    assert tuple(cluster.stats(points, "c").first()) == (0, 2, [4.0, 6.0], [10.0, 20.0])
    got = spark.createDataFrame([(3, [4.0, 3.0])], "id long, x array<double>").select(cluster.mahalanobis_nearest("x", [(0, 2, [4.0, 6.0], [10.0, 20.0])]).alias("b")).first()["b"]
    assert tuple(got) == (2.0, 0)
    line = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate((0, 1, 10, 4))], "id long, x array<double>")
    assert [y[0] for _, y in cluster.farthest_first(line, 3)] == [0.0, 10.0, 4.0]
    rng = __import__("random").Random(1)
    blobs = [(i, [rng.gauss(c, 0.3), rng.gauss(-c, 0.3)]) for i, c in enumerate([0, 10, 20] * 60)]
    rows = spark.createDataFrame(blobs, "id long, x array<double>")
    made = cluster.bfr([rows.where("id < 90"), rows.where("id between 90 and 134"), rows.where("id > 134")], 3, 2)
    assert [r[2] + r[4] + r[5] for r in made.log] == [90, 135, 180]
    assert made.last().count() == 180
    groups = {}
    for r in made.last().collect():
        groups.setdefault(r["cluster"], set()).add(r["id"] % 3)
    assert all(len(g) == 1 for g in groups.values())


def test_relational(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert {r["id"]: r["others"] for r in relational.merged_adjacency(pairs, "a", "b").collect()} == {1: [2, 3], 2: [1], 3: [1]}
    assert relational.both_ways(pairs, "a", "b").count() == 4
    assert [r[0] for r in spark.sql("select array(1,2,3) x, array(1,3) y").select(relational.contains_all("x", "y")).collect()] == [True]


def test_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"review_id": "r", "stars": 4}\n{"review_id": "s", "text": null}\n')
    assert readers.json_lines(spark, str(tmp_path / "r.json"), readers.REVIEW).count() == 2
    (tmp_path / "bad.json").write_text("{oops\n")
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "bad.json"), readers.REVIEW).collect()
    (tmp_path / "p.csv").write_text("user_id,business_id\n")
    assert readers.csv_table(spark, str(tmp_path / "p.csv"), readers.PAIRS).count() == 0
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "b.txt").write_text("1,2.5,3\n")
    (tmp_path / "v" / "a.txt").write_text("0,1,1\n\n7,0,0\n")
    assert [c.count() for c in readers.chunks(spark, str(tmp_path / "v"))] == [2, 1]
    (tmp_path / "m.txt").write_text('Business:\n{"b": ["x", "y"]}\nUsers:\n{"u": ["b"]}\n')
    assert [tuple(m.first()) for m in readers.two_section_model(spark, str(tmp_path / "m.txt"))] == [("b", ["x", "y"]), ("u", ["b"])]
    sets = spark.createDataFrame([(["a"],), (["c"],), (["a", "c"],)], "items array<string>")
    writers.itemset_report(sets, sets, str(tmp_path / "report"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "report"), wholetext=True).collect()]
    assert lines[0].startswith("Candidates:\n('a'),('c')\n\n('a', 'c')\n\nFrequent Itemsets:\n")
    writers.community_lines(spark.createDataFrame([(["b", "c"],), (["a"],)], "members array<string>"), str(tmp_path / "groups"))
    assert spark.read.text(str(tmp_path / "groups"), wholetext=True).first()[0] == "'a'\n'b', 'c'\n"


def test_paths_from_every_vertex_without_a_depth(spark):
    import random

    from pyspark.sql import functions as F

    from stratamine.operators import graph

    rng = random.Random(6)
    pairs = {(i, i + 1) for i in range(7)} | {tuple(sorted(rng.sample(range(8, 20), 2))) for _ in range(20)}
    edges = spark.createDataFrame(sorted(pairs | {(b, a) for a, b in pairs}), "src long, dst long")
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set()
    for root in near:
        level, seen, d = {root: 1}, {root}, 0
        while level:
            want |= {(root, v, d, n) for v, n in level.items()}
            after = {}
            for v, n in level.items():
                for w in near[v] - seen:
                    after[w] = after.get(w, 0) + n
            level, d = after, d + 1
            seen |= set(level)
    got = graph.shortest_paths(edges, edges.select(F.col("src").alias("id")).distinct()).collect()
    assert {(r["root"], r["node"], r["dist"], r["sigma"]) for r in got} == want and len(got) == len(want)
    assert max(d for _, _, d, _ in want) > 4 and max(n for *_, n in want) > 1


def test_path_search(spark):
    points = spark.createDataFrame([(i, n) for i, n in enumerate("abcdef")], "id long, name string")
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 0)], "src long, dst long")
    find = lambda a, b, most=10: sorted(r["path"] for r in graph.path_search(points, edges, F.col("name") == a, F.col("name") == b, most).collect())
    assert find("a", "d") == [[0, 1, 3], [0, 2, 3]] and find("a", "e") == [[0, 1, 3, 4], [0, 2, 3, 4]]
    assert find("a", "a") == [[0]] and find("a", "f") == [] and find("a", "e", 2) == []


def test_strongest_edges(spark):
    rows = spark.createDataFrame([(k, m) for k, ms in enumerate(["abcd", "abcd", "abx", "aby", "q", "r", "s", "t"]) for m in ms], "k long, m string")
    got = sorted((r["src"], r["dst"]) for r in graph.strongest(rows, "k", "m", 4).collect())
    assert got == [(0, 1), (1, 0)]  # six pairs share two, one shares four
    assert graph.strongest(rows, "k", "m", 100).count() == 0


def test_banded_pairs_are_checked_at_every_size(spark, monkeypatch):
    rows = spark.createDataFrame([(k, m) for k, n in ((1, 30), (2, 27), (3, 4), (4, 3)) for m in range(n)] + [(5, None), (6, None)], "k long, m long")
    number, hashes = F.col("m"), hashing.family(35)
    for threshold, at_least, want in ((0.5, 1, [(1, 2, 27, 0.9), (3, 4, 3, 0.75)]), (0.5, 4, [(1, 2, 27, 0.9)]), (0.8, 1, [(1, 2, 27, 0.9)])):
        for short in (10_000, 10, 1):
            monkeypatch.setattr(similarity, "SHORT", short)
            assert sorted(map(tuple, similarity.banded_similar(rows, "k", "m", number, hashes, threshold, at_least).collect())) == want
    assert similarity.banded_similar(rows.limit(0), "k", "m", number, hashes, 0.5).count() == 0


def test_review_words_split_at_backslashes(spark):
    from stratamine.functions.text import review_words

    assert spark.createDataFrame([("a\\b-c",)], "t string").select(review_words(F.col("t"))).first()[0] == ["a", "b", "c"]


def test_random_starts(spark):
    from stratamine.operators import cluster

    points = spark.createDataFrame([(i, [float(i % 2) * 10, float(i)]) for i in range(12)], "id long, x array<double>")
    found = cluster.kmeans(points, 3, start="random").collect()
    assert len(found) == 12 and {r["cluster"] for r in found} <= {0, 1, 2}
    assert cluster.first_by_hash(points, 3) == cluster.first_by_hash(points.repartition(5), 3)


def test_cluster_report(spark, tmp_path):
    from stratamine.sources import readers, writers

    rounds = spark.createDataFrame([(1, 5), (2, 7)], "round int, n int")
    clusters = spark.createDataFrame([("a", 0), ("b", -1)], "id string, cluster int")
    writers.cluster_report(rounds, clusters, str(tmp_path))
    assert sorted(map(tuple, readers.csv_table(spark, f"{tmp_path}/rounds", "round int, n int").collect())) == [(1, 5), (2, 7)]
    assert sorted(map(tuple, readers.json_lines(spark, f"{tmp_path}/clusters", "id string, cluster int").collect())) == [("a", 0), ("b", -1)]


def test_pushed_stream(spark, tmp_path):
    from stratamine.sources.push import keeps, pushed

    sent = [("The Album is out", "en"), ("das album", "de"), ("nothing here", "en"), (None, "en"), ("album 2", "en")]

    def feed(at):
        return sent[at : at + 2], min(at + 2, len(sent))

    assert [keeps(*r, ["album"], ["en"]) for r in sent] == [True, False, False, False, True]
    assert all(keeps(*r, [], []) for r in sent)
    query = pushed(spark, feed, ["ALBUM"], ["en"]).writeStream.format("memory").queryName("fed").option("checkpointLocation", str(tmp_path)).trigger(processingTime="0 seconds").start()
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if spark.table("fed").count() >= 2:
                break
        assert sorted(r["text"] for r in spark.table("fed").collect()) == ["The Album is out", "album 2"]
    finally:
        query.stop()


def test_merged_clusters_reach_their_last_home(spark):
    import numpy as np

    made = cluster.BFR(2)
    made.parts = [spark.createDataFrame([(1, 0), (2, 1), (3, 5), (4, 6), (5, 7)], "id long, cluster int")]
    made.retained = spark.createDataFrame([(6, [9.0])], "id long, x array<double>")
    made.discard = {0: [2, np.array([0.0]), np.array([2.0])], 1: [2, np.array([20.0]), np.array([202.0])]}
    made.compressed = {7: [2, np.array([19.0]), np.array([181.0])]}
    made.merged = {5: 6, 6: 7}
    assert {r["id"]: r["cluster"] for r in made.last().collect()} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}


@pytest.mark.parametrize("named", [False, True])
def test_pairs_are_counted_where_lists_meet(spark, monkeypatch, named):
    import math
    import random
    import re

    from stratamine.operators import pairs

    rng = random.Random(4)
    stars = {(k, m): rng.choice([None, 1.0, 2.5, 4.0, 5.0]) for m in range(25) for k in rng.sample(range(40), rng.randint(1, 12)) + [40]}  # 40 is in all
    name = (lambda k: f"k{k:02}é") if named else (lambda k: k)
    rows = [(name(k), m, s) for (k, m), s in stars.items()] + [(None, 1, 2.0), (name(1), None, 2.0)]
    df = spark.createDataFrame(rows, f"b {'string' if named else 'long'}, u long, s double")
    want = {}
    for a in range(41):
        for b in range(a + 1, 41):
            both = [(stars[a, m], stars[b, m]) for m in range(25) if (a, m) in stars and (b, m) in stars]
            x, y, xy = [p for p, _ in both if p is not None], [q for _, q in both if q is not None], [(p, q) for p, q in both if None not in (p, q)]
            dev = lambda v: math.sqrt(sum((i - sum(v) / len(v)) ** 2 for i in v) / len(v)) if v else 0.0
            spread, mean = round(dev(x) * dev(y), 9), lambda i: sum(p[i] for p in xy) / len(xy)  # noqa: B023
            if len(both) >= 2:
                want[name(a), name(b)] = (len(both), sum((p - mean(0)) * (q - mean(1)) for p, q in xy) / len(xy) / spread if xy and spread else 0.0)
    for most, chunk, batch in ((4_000_000, 1 << 20, 1 << 18), (40, 3, 5)):
        monkeypatch.setattr(pairs, "PAIRS", most)
        monkeypatch.setattr(pairs, "CHUNK", chunk)
        monkeypatch.setattr(pairs, "BATCH", batch)
        found = recommend.pearson_pairs(df, "b", "u", 2)
        assert not re.search(r"hashpartitioning\([^,()]+, [^,()]+, \d+\)", found._jdf.queryExecution().toString())  # no pair is moved
        got = {(r["k1"], r["k2"]): (r["both"], r["sim"]) for r in found.collect()}
        assert got.keys() == want.keys() and all(got[p][0] == n and abs(got[p][1] - s) < 1e-6 for p, (n, s) in want.items())
        assert {(r["k1"], r["k2"]): r["both"] for r in relational.shared(df, "b", "u", 2).collect()} == {p: n for p, (n, _) in want.items()}
        sets = spark.createDataFrame([(1, m) for m in "abcdef"] + [(2, m) for m in "abcx"] + [(3, m) for m in "xyz"], "k int, m string")
        assert sorted(map(tuple, similarity.jaccard_pairs(sets, "k", "m", 0.3).collect())) == [(1, 2, 3, 0.428571)]
        assert similarity.jaccard_pairs(sets.where("k = 1"), "k", "m", 0.1).count() == 0


def test_sets_meet_in_ranges_of_bands(spark, monkeypatch):
    import random

    from stratamine.operators import bands

    rng = random.Random(9)
    sets = {f"k{i:02}": frozenset(rng.sample(range(30), rng.randint(1, 15))) for i in range(40)} | {"z": frozenset(range(30))}
    df = spark.createDataFrame([(k, m) for k, s in sets.items() for m in s] + [(None, 3), ("k01", None)], "k string, m long")
    hashes = hashing.family(6)
    least = {k: [min((a * m + b) % hashing.PRIME for m in s) for _, a, b in hashes] for k, s in sets.items()}
    near = [(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets if a < b and any(x == y for x, y in zip(least[a], least[b], strict=True))]
    want = sorted((a, b, n, round(n / m, 6)) for a, b, n, m in near if n / m >= 0.3 and n >= 3)
    for most, chunk, looked in ((4_000_000, 1 << 20, 1 << 21), (60, 5, 20)):
        monkeypatch.setattr(bands, "PAIRS", most)
        monkeypatch.setattr(bands, "CHUNK", chunk)
        monkeypatch.setattr(bands, "LOOKED", looked)
        monkeypatch.setattr(bands, "CELLS", 40)
        found = similarity.banded_similar(df, "k", "m", F.col("m"), hashes, 0.3, 3)
        assert "explode" not in found._jdf.queryExecution().toString()  # no set is sent once for each function
        assert sorted(map(tuple, found.collect())) == want
    assert {tuple(r) for r in similarity.banded_pairs(similarity.signatures(df.where("k is not null and m is not null"), "k", F.col("m"), hashes)).collect()} == {p[:2] for p in near}


def test_sets_grow_where_an_items_baskets_are(spark, monkeypatch):
    import random
    from itertools import combinations

    from stratamine.operators import pairs

    rng = random.Random(2)
    sets = [sorted(rng.sample("abcdefghij", rng.randint(1, 6))) for _ in range(60)]
    rows = spark.createDataFrame([(i, x) for i, s in enumerate(sets) for x in s], "basket long, item string")
    want = {}
    for s in sets:
        for k in range(1, 7):
            for c in combinations(s, k):
                want[c] = want.get(c, 0) + 1
    want = {c: n for c, n in want.items() if n >= 4}
    as_dict = lambda df: {tuple(r["items"]): r["support"] for r in df.collect()}
    for most, chunk, batch in ((4_000_000, 1 << 20, 1 << 18), (90, 7, 5)):
        monkeypatch.setattr(pairs, "PAIRS", most)
        monkeypatch.setattr(pairs, "CHUNK", chunk)
        monkeypatch.setattr(pairs, "BATCH", batch)
        found = itemsets.by_growth(rows, 4)
        assert as_dict(found) == want
        assert as_dict(itemsets.frequent(rows, 3, 4)) == {c: n for c, n in want.items() if len(c) == 3}
        assert "hashpartitioning(items" not in itemsets.frequent(rows, 2, 4)._jdf.queryExecution().toString()  # no candidate is moved
    assert as_dict(itemsets.by_growth(rows.where("basket < 1 and item = 'q'"), 1)) == {}


def test_rounds_of_k_means_write_no_points(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(8).normal(size=(300, 3)) * 5
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    centres = x[[0]]
    while len(centres) < 4:
        centres = np.concatenate([centres, x[[((x[:, None] - centres) ** 2).sum(2).min(1).argmax()]]])
    rounds, at = 0, ((x[:, None] - centres) ** 2).sum(2).argmin(1)
    for _ in range(30):
        before, rounds = at, rounds + 1
        centres = np.stack([x[at == c].mean(0) for c in range(4)])
        at = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        if (before == at).all():
            break
    settled = []
    monkeypatch.setattr(cluster, "settle", lambda df, settle=cluster.settle: settled.append(1) or settle(df))
    assert [r["cluster"] for r in cluster.kmeans(points, 4).orderBy("id").collect()] == at.tolist()
    assert rounds > 3 and len(settled) == 1
