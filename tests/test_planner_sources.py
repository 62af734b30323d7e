import json
import time

import pytest
from pyspark.sql import functions as F

from grainfold.functions import logic
from grainfold.operators import metrics, relational, semantic
from grainfold.plans import judges, planner, specs, tags
from grainfold.plans.cascade import CascadePlan, one_plan, staged
from grainfold.plans.specs import Question, Step, Structural, TableSpec
from grainfold.sources import content, files, sinks

TABLE = TableSpec("r", "k", ("review_text",), ("n",))
SRC = judges.WordQuestions({"up": [["good"]] * 6, "down": [["bad"]] * 6}, {1: 2, 2: 4, 3: 6})


def reviews(spark, n=60):
    return spark.createDataFrame([(f"r{i:03}", ["good", "bad", "good bad", None][i % 4], i) for i in range(n)], "k string, review_text string, n int")


def test_plans_from_json_and_their_faults():
    p = planner.plan_from_json({"structural": [{"column": "n", "op": "<", "value": 9}], "predicates": [{"phrase": "up"}, {"phrase": "down"}], "limit": 3}, TABLE)
    assert p.limit == 3 and list(p.logic.leaves()) == ["up", "down"]
    for bad in ({"structural": [{"column": "x", "op": "<", "value": 9}]}, {"structural": [{"column": "n", "op": "~", "value": 9}]}, {"predicates": [{"phrase": "up"}], "logic": 4}):
        with pytest.raises(ValueError):
            planner.plan_from_json(bad, TABLE)


def test_structural_verification(spark):
    df = spark.createDataFrame([(1,), (None,), (5,)], "n int")
    ok = Structural("n", ">", 2)
    assert planner.verify_structural(df, [ok]) == (True, 3, 1, None)
    assert planner.verify_structural(df, [Structural("x", ">", 2)])[3] == "unknown column x" and "unknown operator" in planner.verify_structural(df, [Structural("n", "~", 2)])[3]
    assert planner.verify_structural(df.limit(0), [ok]) == (False, 0, 0, "empty sample")


def test_a_query_stops_early_and_stores_what_it_learned(spark, monkeypatch):
    monkeypatch.setattr(planner, "FIRST_BLOCK", 8)
    plan = planner.plan_from_json({"predicates": [{"phrase": "up"}], "limit": 3}, TABLE)
    empty = spark.createDataFrame([], "k string, predicate_canon string, tag_value boolean, confidence double, settled_tier smallint, settled_modality string, source_updated_at timestamp")
    history = spark.createDataFrame([], "predicate string, query_label string, first_seen_at timestamp")
    e = planner.Engine(SRC, specs.text_only(), tags=empty, history=history)
    got = planner.run(plan, reviews(spark), e, "q")
    assert [r.k for r in got.answers.orderBy("k").collect()] == ["r000", "r002", "r004"] and 8 <= got.calls <= 24
    assert got.tags.count() == 8 and [tuple(r)[:2] for r in got.history.collect()] == [("up", "q")]
    all_ = planner.run(planner.plan_from_json({"predicates": [{"phrase": "up"}]}, TABLE), reviews(spark), planner.Engine(SRC, specs.text_only(), chunk=7))
    assert {r.k for r in all_.answers.collect()} == {f"r{i:03}" for i in range(60) if i % 4 in (0, 2)}
    none = planner.run(planner.plan_from_json({"predicates": [{"phrase": "up"}], "limit": 3}, TABLE), reviews(spark).limit(0), e)
    assert none.answers.count() == 0 and none.calls == 0


def test_fresh_answers_to_a_negation_are_inverted(spark):
    df = reviews(spark).withColumnRenamed("n", "known")
    for forced in (specs.text_only(), specs.single_stage()):
        p = CascadePlan(logic.parse("not up"), {"not up": "objective"}, forced, negates={"not up": "up"})
        want = {f"r{i:03}": i % 4 == 1 for i in range(60)}
        assert {r.k: r.answer for r in one_plan(df, p, SRC).select("k", "answer").collect()} == want
        assert {r.k: r.answer for r in staged(df.select("k"), "k", df, p, SRC).state.collect()} == want


def test_calls_are_limited_in_time_and_number():
    tries = []
    assert judges.limited(lambda: tries.append(1) or 1 / 0, 1.0, attempts=3, pause=0.01) is None and len(tries) == 3
    t = time.time()
    assert judges.limited(lambda: time.sleep(5), 0.05, attempts=2, pause=0.01) is None and time.time() - t < 2
    assert judges.read_match('{"matches": true}') == (True, 1.0) and judges.read_match('{"matches": "No"}') == (False, 1.0)
    assert judges.read_evidence("true because " + "x" * 300)[-1] == "…" and judges.read_evidence('{"matches": false, "evidence": "a\\nb"}') == "a b"
    assert judges.localized("Is this product one of the products? Products", "review") == "Is this review one of the reviews? Reviews"


def test_sub_questions_in_batches(spark):
    spec = specs.PredicateSpec("up", questions=(Question("u_C1", "content", "good?"), Question("u_M1", "meta", "long?")))
    raw = {"fine": lambda p, q, t: json.dumps([{"index": i + 1, "answers": "TF" if "good" in x else "FU"} for i, x in enumerate(t)]) if len(t) > 1 else json.dumps("TF" if "good" in t[0] else "FU"), "broken": lambda p, q, t: "sorry"}
    for name, client in raw.items():
        s = judges.SubQuestionSource({"up": spec}, client, "review_text", batch=4, workers=2, pause=0.01)
        got = {r.k: (r.direction, round(r.confidence, 6)) for r in s.answer(reviews(spark, 12), "k", "up", Step(1), False).collect()}
        assert len(got) == 12 and got["r000"] == ((True, 0.7) if name == "fine" else (None, 0.15)) and got["r001"] == ((False, 0.85) if name == "fine" else (None, 0.15))
    assert judges.read_sub_answers('[{"sub_id": "a", "answer": "T"}]', 1, ["a", "b"]) == [{"a": "T", "b": "MISSING"}]
    assert specs.id_prefix("is_a") == "is" and specs.id_prefix("is_the_best") == "bes" and specs.id_prefix("") == "prd"


def test_files_and_registries(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "a",\n "n": 1}\n\n{"id": "b", "n": [}\n{"id": "c",\n\n"n": 3}')
    rows = files.spanning_json(spark, str(tmp_path / "a.jsonl"), "id string, n int").collect()
    assert sorted((r.id, r.n) for r in rows if r.bad is None) == [("a", 1), ("c", 3)] and sum(r.bad is not None for r in rows) == 1
    (tmp_path / "b.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": "b", "n": 2}\n{"id": "a", "n": 5}\n')
    assert sorted(tuple(r) for r in files.strict_json(spark, str(tmp_path / "b.jsonl"), "id string, n int", "id").collect()) == [("a", 5), ("b", 2)]
    (tmp_path / "c.jsonl").write_text('{"id": "a"\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.strict_json(spark, str(tmp_path / "c.jsonl"), "id string", "id").collect()
    (tmp_path / "q.json").write_text('{"queries": [{"id": 1, "gold_sql": "SELECT {t3} FROM x"}, {"id": 2}]}')
    assert files.query_catalogue(str(tmp_path / "q.json"), {"t3": "a"})[1]["gold_sql"] == "SELECT a FROM x"
    with pytest.raises(KeyError):
        files.query_catalogue(str(tmp_path / "q.json"), {})
    folder = tmp_path / "preds"
    folder.mkdir()
    spec = {"slug": "is_good", "scheme": "related", "n": 2, "subquestions": [["g_R1", "related", "x"], ["g_R2", "related", "y"]], "aliases": ["is_fine"]}
    (folder / "a.json").write_text(json.dumps(spec))
    got = files.predicate_registry(str(folder))
    assert set(got) == {"is_good", "is_fine"} and got["is_fine"].questions == got["is_good"].questions and got["is_good"].is_related
    (folder / "b.json").write_text(json.dumps({**spec, "slug": "odd", "n": 3, "aliases": []}))
    with pytest.raises(ValueError):
        files.predicate_registry(str(folder))
    assert files.bundle('{"meta": {"a": 1}}') == ({"a": 1}, [])
    for bad in ("[]", '{"meta": 1}', '{"meta": {}, "reviews": [1]}'):
        with pytest.raises(ValueError):
            files.bundle(bad)


def test_text_sections_in_parts_and_images(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "id string")
    t = {"m": spark.createDataFrame([("a", "x", ["p", ""]), ("b", None, None)], "id string, title string, tags array<string>"), "r": spark.createDataFrame([(i, "a", f"t{i}", "u" if i else "") for i in range(5)], "i int, mid string, line string, url string")}
    src = [content.SourceTable("m", ("title", "tags"), "id"), content.SourceTable("r", ("line",), "i", join_on="mid", filters={"i": ">= 1"}), content.SourceTable("r", ("url",), "i", "image", "mid")]
    got = {(r.id, r.section, r.part): r.text for r in content.text_sections(keys, "id", src, t, rows_a_part=3).collect()}
    assert got[("a", 0, 0)] == "## SOURCE: m\ntitle: x\ntags: - p" and got[("b", 0, 0)] == "## SOURCE: m" and got[("b", 1, 0)].endswith("(no rows matched)")
    assert got[("a", 1, 0)] == "## SOURCE: r\n### row 1\nline: t1\n### row 2\nline: t2\n### row 3\nline: t3" and got[("a", 1, 1)] == "### row 4\nline: t4"
    assert [r.url for r in content.image_addresses(keys, "id", src, t).collect()] == ["u"] * 4
    im = spark.createDataFrame([([("PT01", "p", None, None), ("MAIN", None, "h", "t")],), ([("MAIN", "", None, None), ("PT01", None, None, "t")],), ([],), (None,)], "i array<struct<variant:string,large:string,hi_res:string,thumb:string>>")
    assert [r[0] for r in im.select(content.first_image(F.col("i"))).collect()] == ["h", "t", None, None]


def test_stores_schedules_and_reports(spark, tmp_path):
    schema = "parent_asin string, predicate_canon string, tag_value boolean"
    df = spark.createDataFrame([("a", "p", True), ("b", "p", False), ("a", "q", True)], schema)
    store = tags.TagStore(spark, str(tmp_path / "s"), df.schema)
    store.write(df)
    old = store.read()
    store.upsert(spark.createDataFrame([("a", "p", False)], schema), ["parent_asin", "predicate_canon"])
    assert old.where("tag_value").count() == 2 and store.read().where("tag_value").count() == 1 and store.read().count() == 3
    assert tags.clear(df, ["p"]).count() == 1 and tags.clear(df).count() == 0 and tags.clear(df, None, df.where("parent_asin = 'b'")).count() == 2
    for i in range(3):
        (tmp_path / "s" / "pointers" / f"{7 + i:012d}").mkdir()  # a pointer that is not complete does not count
    assert store.read().count() == 3
    m = {"q1": {"f1": 0.5, "n": 3}, "q2": {"f1": None}}
    assert sinks.as_markdown(m).splitlines() == ["| query | f1 | n |", "|---|---|---|", "| q1 | 0.5000 | 3 |", "| q2 | - | - |"] and json.loads(sinks.as_json(m)) == m and sinks.as_text({"q": {"a": 1.0}}) == "q  a=1.0000"
    log = str(tmp_path / "log")
    for _ in range(2):
        sinks.append_log(df, log)
    assert sinks.read_log(spark, log, schema).count() == 6


def test_measures_and_proxy_join(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (3.0, 1.0), (None, 1.0)], "s double, t double")
    r = metrics.mean_error_and_correlation(df, F.col("s"), F.col("t")).first()
    assert abs(r.mae - 4 / 3) < 1e-5 and abs(r.pearson - 0.866025) < 1e-6
    assert metrics.mean_error_and_correlation(df.limit(1), F.col("s"), F.col("t")).first().pearson == 0.0
    rows = [(r.id, r.t) for r in relational.running_total(spark.range(100), ["id"], "id", "t").collect()]
    assert all(t == i * (i + 1) // 2 for i, t in rows)
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [0.6, 0.8])], "id bigint, v array<double>")
    for block in (1, 100):
        got = {(r.query, r.id) for r in semantic.proxy_scores(e, e.where("id < 3"), "id", "v", 0.5, block).collect()}
        assert got == {(0, 1), (1, 0), (0, 5), (1, 5), (2, 5)}
    low, high = semantic.accuracy_thresholds(spark.createDataFrame([(0.9, True), (0.8, True), (0.7, False), (0.6, True), (0.1, False)], "s double, t boolean"), "s", "t")
    assert (low, high) == (0.6, 0.8)


def test_stored_frames_can_be_removed(spark):
    from pathlib import Path

    from grainfold import session

    df = session.written(spark.range(3), "x")
    path = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert df.count() == 3 and path.exists()
    session.clean(spark)
    assert not path.exists() and not session._stored
