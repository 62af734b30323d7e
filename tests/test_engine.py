import random

import pytest
from pyspark.sql import functions as F

from grainfold.functions import logic, text, verdicts
from grainfold.operators import metrics, relational
from grainfold.plans import judges, specs, tags
from grainfold.plans.cascade import CascadePlan, one_plan, staged
from grainfold.plans.specs import Step


def random_tree(rng, names, depth=2):
    if depth == 0 or rng.random() < 0.3:
        return logic.Leaf(rng.choice(names))
    return logic.Node(rng.choice(["AND", "OR"]), tuple(random_tree(rng, names, depth - 1) for _ in range(rng.randint(1, 3))))


def on_open_paths(tree, values):
    """Leaves that are undecided, as is every node above them."""
    if logic.evaluate(tree, values) is not None:
        return set()
    return {tree.name} if isinstance(tree, logic.Leaf) else {n for c in tree.children for n in on_open_paths(c, values)}


def test_column_folding_equals_plain_evaluation(spark):
    rng = random.Random(1)
    vals = [(a, b, c) for a in (True, False, None) for b in (True, False, None) for c in (True, False, None)]
    df = spark.createDataFrame(vals, "a boolean, b boolean, c boolean")
    leaf = {x: F.col(x) for x in "abc"}
    trees = [random_tree(rng, "abc") for _ in range(15)]
    got = df.select("a", "b", "c", *[logic.fold(t, leaf).alias(f"t{i}") for i, t in enumerate(trees)], *[logic.needed(t, leaf)[n].alias(f"n{i}{n}") for i, t in enumerate(trees) for n in set(t.leaves())]).collect()
    for r in got:
        v = {x: r[x] for x in "abc"}
        for i, t in enumerate(trees):
            assert r[f"t{i}"] == logic.evaluate(t, v)
            assert {n for n in set(t.leaves()) if r[f"n{i}{n}"]} == on_open_paths(t, v)


def test_parse_and_order():
    t = logic.parse("a AND b OR c")
    assert t.op == "OR" and t.children[0].op == "AND" and logic.parse("(a OR b) AND c").op == "AND"
    assert logic.from_json({"op": "or", "children": [0, 5]}, ["a"]) is None
    for bad in ("a AND", "(a", "a b)"):
        with pytest.raises(ValueError):
            logic.parse(bad)
    rates = logic.KillRates({"veg": 0.065, "ind": 0.04}, {"veg": 0.175, "ind": 0.5})
    assert logic.leaf_order(logic.parse("veg AND ind"), rates) == ["ind", "veg"]
    assert logic.leaf_order(logic.parse("veg OR ind"), rates) == ["veg", "ind"]
    assert logic.leaf_order(logic.parse("veg AND ind"), rates, reuse={"veg": 1.0}, weight=1.0) == ["veg", "ind"]
    assert logic.subtree_order(logic.parse("(a OR b) AND c"), logic.KillRates({}, {"a": 0.5, "b": 0.9, "c": 0.4})) == ["c", "a", "b"]  # 0.5 * 0.9 / 2 < 0.4


def test_verdict_vectors(spark):
    cases = [((6, 0), (True, 1.0)), ((4, 0), (True, 4 / 6)), ((3, 0), (None, 0.5)), ((2, 2), (None, 0.5)), ((2, 0), (False, 4 / 6)), ((0, 0), (False, 1.0)), ((0, 6), (None, 0.5))]
    df = spark.createDataFrame([c[0] for c in cases], "t int, u int")
    got = df.select(verdicts.related(F.col("t"), F.col("u"), F.lit(6)).alias("v"), verdicts.related(F.col("t"), F.col("u"), F.lit(6), True).alias("f")).collect()
    for r, (_, want) in zip(got, cases):
        assert r.v.direction == want[0] and abs(r.v.confidence - want[1]) < 1e-12
        assert r.f.direction == (False if want[0] is None else want[0])
    one = spark.range(1)
    cm = one.select(verdicts.content_meta(F.lit(0.5), F.lit(0.5)).alias("v"), verdicts.alpha_confidence(F.lit(1.0), F.lit(0.5), 0.4).alias("a")).first()
    assert cm.v.direction is False and abs(cm.v.confidence - 0.15) < 1e-12 and abs(cm.a - 0.85) < 1e-12


def test_names_filters_specs():
    assert text.canonicalize("  Is Gluten-free!! ") == "tag_is_gluten_free" and len(text.canonicalize("x" * 80)) == 63
    with pytest.raises(ValueError):
        text.canonical_names(["a" * 70, "a" * 71])
    assert text.coerce("4") == 4 and text.coerce("1.5") == 1.5 and text.coerce("'x'") == "x"
    c = specs.CascadeConfig()
    assert [c.resume_offset("objective", *x) for x in ((1, "text"), (2, "text"), (1, "text_image"), (3, "text"), (3, "text_image"), (None, None))] == [1, 2, 3, 5, 0, 0]
    assert [c.trusted(*x) for x in ((1, "text", 0.89), (1, "text", 0.9), (2, "text", 0.79), (3, "text", 0.01))] == [False, True, False, True]
    assert [specs.effective_batch(*x) for x in ((50, 6, 20), (2000, 6, 20), (8, 5, 8), (99, 1, 2))] == [3, 6, 1, 1]
    assert specs.question_ids("is_a_positive_review", 1, 1) == [("pos_C1", "content"), ("pos_M1", "meta")]


def test_response_readers():
    assert judges.read_match("TRUE, because") == (True, 1.0) and judges.read_match("```{\"match\": false}```") == (False, 1.0) and judges.read_match("hm") == judges.GIVEN_UP
    assert judges.read_positions("TFU", ["a", "b", "c"]) == {"a": "T", "b": "F", "c": "cannot_determine"} and judges.read_positions("TF", ["a"]) is None
    assert judges.read_verbose([{"sub_id": "a", "answer": "T"}, {"sub_id": "z", "answer": "T"}], ["a", "b"]) == {"a": "T", "b": "MISSING"}
    assert judges.read_batch([{"index": 2, "answers": "F"}, {"index": 1, "answers": "T"}], 2, ["a"]) == [{"a": "T"}, {"a": "F"}] and judges.read_batch([{"index": 1, "answers": "T"}], 2, ["a"]) is None
    assert judges.read_predicates('{"results": [{"predicate_idx": 0, "answer": true}, {"predicate_idx": 9, "answer": true}]}', [0, 1]) == ({0: True}, ["unexpected 9", "missing 1"])


def test_cascade_forms_agree_and_judge_once(spark):
    rng = random.Random(2)
    words = ["good", "fine", "bad", "poor", "nice", "dull"]
    rows = [(f"r{i}", None if i % 17 == 0 else " ".join(rng.choices(words, k=4))) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, review_text string")
    src = judges.WordQuestions({"up": [["good"], ["fine"], ["nice"], ["good fine"], ["nice good"], ["fine nice"]], "down": [["bad"], ["poor"], ["dull"], ["bad poor"], ["dull"], ["poor"]]}, {1: 2, 2: 4, 3: 6})
    for expr in ("up AND down", "up OR down"):
        p = CascadePlan(logic.parse(expr), {"up": "objective", "down": "objective"}, specs.text_only())
        a = one_plan(df, p, src)
        lazy = {r.k: r.answer for r in a.select("k", "answer").collect()}
        calls = a.agg(F.sum(F.col("calls_t1") + F.col("calls_t2") + F.col("calls_t3"))).first()[0]
        b = staged(df.select("k"), "k", df, p, src)
        assert lazy == {r.k: r.answer for r in b.state.collect()} and calls == b.calls == b.trace.count() and None not in lazy.values()


def test_vector_source_gives_up_after_failures(spark):
    df = spark.createDataFrame([("a", "yes"), ("b", None)], "k string, t string")

    def broken(slug, texts):
        raise RuntimeError("down")

    got = judges.VectorSource(broken, "t").answer(df, "k", "x", Step(1), False).collect()
    assert {(r.direction, r.confidence) for r in got} == {judges.GIVEN_UP}
    fine = judges.VectorSource(lambda s, t: ["true"] * len(t), "t", batch=1).answer(df, "k", "x", Step(1), True).collect()
    assert [r.direction for r in fine] == [True, True]


def test_tag_snapshot_store_and_relations(spark, tmp_path):
    schema = "parent_asin string, predicate_canon string, tag_value boolean, confidence double, settled_tier int, settled_modality string, source_updated_at timestamp"
    from datetime import datetime

    t = datetime(2020, 1, 1)
    df = spark.createDataFrame([("a", "p", True, 0.5, 1, "text", t), ("a", "p", False, 0.9, 1, "text", t), ("b", "p", None, None, None, None, None)], schema)
    got = {r.parent_asin: r.tag_value for r in tags.snapshot(df).collect()}
    assert got == {"a": False, "b": None}
    store = tags.TagStore(spark, str(tmp_path / "s"), df.schema)
    assert store.read().count() == 0
    store.upsert(df.where("parent_asin = 'b'"), ["parent_asin", "predicate_canon"])
    store.upsert(tags.snapshot(df), ["parent_asin", "predicate_canon"])
    assert store.read().count() == 2
    rel = tags.Relations({("is not good", "is good"): "NEGATION"})
    assert rel.match("is good", ["tag_is_good"])[1] == "EXACT" and rel.match("is not good", ["tag_is_good"])[1] == "NEGATION" and rel.match("else", ["tag_is_good"]) == (None, "NONE")
    assert tags.Reuse("NEGATION").write_column("own", "cached") == "own" and tags.Reuse("EQUIVALENT").write_column("own", "cached") == "cached"


def test_ranks_and_metrics(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("x"), (F.col("id") % 5).alias("y"))
    got = sorted((r.rn, r.id) for r in relational.global_rank(spark.range(50), ["id"]).collect())
    assert got == [(i, i) for i in range(50)]
    import numpy as np

    rows = [(r.x, r.y) for r in df.collect()]
    s = sum(np.sign(a[0] - b[0]) * np.sign(a[1] - b[1]) for i, a in enumerate(rows) for b in rows[:i])
    n, tie = len(rows), lambda k: sum(a[k] == b[k] for i, a in enumerate(rows) for b in rows[:i])
    want = s / np.sqrt((n * (n - 1) / 2 - tie(0)) * (n * (n - 1) / 2 - tie(1)))
    assert abs(metrics.kendall(df, "x", "y").first().tau - want) < 1e-5
    assert metrics.spearman(df.limit(1), "x", "y").first().rho == 0.0
    empty = spark.createDataFrame([], "k string")
    assert tuple(metrics.retrieval(empty, empty, "k", 5).first()) == (1.0, 0.0, 0.0)
    p95 = relational.nearest_rank(spark.range(1, 101).withColumn("g", F.lit("a")), ["g"], "id", 0.95, "p").first().p
    assert p95 == 95


def test_entry_names_match():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and {"p1_found", "p2_found", "p3_found", "p7_found", "q10"} <= set(q)


@pytest.mark.parametrize("confs", [[1.0], [0.5, 0.75, 1.0], [i / 400 for i in range(400)]])
def test_first_pairs_of_every_group_equal_listed_pairs(spark, confs):
    rng = random.Random(len(confs))
    sizes = {"large": 160, "true": 30, "one": 1, "two": 2, "few": 5, "lone": 41}
    rows = [(g, f"{g}{i:03d}", True if g == "true" else i == 17 if g == "lone" else rng.random() < 0.4, rng.choice(confs)) for g, n in sizes.items() for i in range(n)]
    rows += [("few", "few9", None, 1.0), (None, "x", True, 1.0), ("two", "two9", True, None)]
    df = spark.createDataFrame(rows, "g string, k string, t boolean, c double")
    for same in (True, False):
        listed = [tuple(r) for r in relational.pair_rows(df, "g", "k", "t", "c", same).select("g", "rid1", "rid2", "pair_conf", "rn").collect()]
        for conf, order in ((None, lambda p: (p[4], p[1], p[2])), ("c", lambda p: (-p[3], p[4], p[1], p[2]))):
            want = {(*p[:3], p[4], n) for g in sizes for n, p in enumerate(sorted((p for p in listed if p[0] == g), key=order)[:10], 1)}
            got = [(r.g, r.rid1, r.rid2, r.rn, r.place) for r in relational.first_pairs(df, "g", "k", "t", conf, same).collect()]
            assert set(got) == want and len(got) == len(want) > 20
        partners = {(r.g, r.k): r for r in relational.pair_partners(df, "g", "k", "t").collect()}
        assert len(partners) == len(rows) - 2
        n = "n_same" if same else "n_opposite"
        assert sum(r[n] for r in partners.values()) == 2 * len(listed)
