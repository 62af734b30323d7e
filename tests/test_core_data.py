from datetime import datetime
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import functions as F

from grainfold.operators.orphans import classify_references, orphan_report
from grainfold.operators.packed import Segmenter, explode_packed
from grainfold.operators.skew import Measure, eager_join_aggregate, heavy_from_states, heavy_keys, key_text
from grainfold.operators.units import QuantityReader, to_common_scale

T = lambda d: datetime(2020, 1, d)


def classify(spark, refs, parents, share=0.005):
    r = spark.createDataFrame(refs, "k string, id string, t timestamp, open int, `__key` string")
    p = spark.createDataFrame(parents, "id string, a timestamp, b timestamp, t string")
    return classify_references(r, p, row_key=F.col("k"), ref_key=F.col("id"), at=F.col("t"), parent_key=F.col("id"), valid_from=F.col("a"), valid_to=F.col("b"), hot_share=share)


def test_references_by_state_with_clashing_columns_and_bounds(spark):
    parents = [("m", T(5), T(10), "x"), ("m", T(15), None, "x"), ("n", None, None, "x"), ("z", T(9), T(2), "x"), (None, T(1), None, "x")]
    refs = [("r1", "m", T(4), 0, ""), ("r2", "m", T(5), 0, ""), ("r3", "m", T(10), 0, ""), ("r4", "m", T(16), 0, ""), ("r5", "q", T(5), 0, ""), ("r6", "n", T(5), 0, ""), ("r7", "m", None, 0, ""), ("r8", None, T(5), 0, ""), ("r9", "z", T(9), 0, "")]
    got = {r.row_key: r.state for r in classify(spark, refs, parents).collect()}
    assert got == {"r1": "late", "r2": "present", "r3": "deleted", "r4": "present", "r5": "missing", "r6": "late", "r7": "undated", "r9": "late"}
    report = {(r.month, r.state): r.orphans for r in orphan_report(classify(spark, refs, parents), "t").collect()}
    assert report[(None, "undated")] == 1 and sum(report.values()) == 6


def test_hot_reference_key_is_salted_without_changing_the_result(spark):
    refs = [(f"r{i}", "hot" if i % 3 else f"k{i}", T(1 + i % 28), 0, "") for i in range(600)]
    parents = [("hot", T(3), T(20), "x")]
    a = {tuple(r) for r in classify(spark, refs, parents, 0.01).collect()}
    assert a == {tuple(r) for r in classify(spark, refs, parents, 1.1).collect()} and len(a) == 600


def test_empty_inputs(spark):
    assert classify(spark, [], []).count() == 0
    assert {r.state for r in classify(spark, [("r", "m", T(1), 0, "")], []).collect()} == {"missing"}


NAMES = ["Kids & Family", "Heist; Caper", "Short, Experimental", "Stage/Concert", "Music", "Musical", "LGBTQ+"]


def test_segmentation_keeps_delimiters_inside_known_and_quoted_values():
    s = Segmenter(NAMES)
    assert s.split("kids & family & Music") == ("kids & family", "Music")
    assert s.split('["Heist; Caper", "Odd, One"]') == ("Heist; Caper", "Odd, One")
    assert s.split("Stage/Concert/Musical | LGBTQ+|") == ("Stage/Concert", "Musical", "LGBTQ+")
    assert s.split("|  |,") == () and s.split("") == () and s.split("Musicals") == ("Musicals",)
    assert s.split("short, experimental, a") == ("short, experimental", "a")
    assert len(s.split(",".join(["x" * 50] * 2000))) == 2000


def test_quoted_values_of_any_length():
    long_ = "one, two; " * 1000 + "end"
    s = Segmenter(NAMES)
    assert s.split(f'"{long_}", Music') == (long_, "Music")
    assert s.split(f"Music; “{long_}” | 'it's, so'") == ("Music", long_, "it's, so")
    assert len(s.split('"' * 20_000 + "a, b")) == 2


def test_dictionary_in_blocks_gives_the_same_values(spark):
    rows = [("a", "short, experimental, Stage/Concert; Heist; Caper | (Music)"), ("b", "LGBTQ+/Kids & Family"), ("c", None), ("d", "")]
    df = spark.createDataFrame(rows, "id string, g string")
    one, many = ({tuple(r) for r in explode_packed(df, F.col("g"), NAMES, [F.col("id")], block=n).collect()} for n in (100, 2))
    assert one == many and ("a", 3, "Heist; Caper") in one and len(one) == 6
    assert [r.value for r in explode_packed(df.where("id = 'b'"), F.col("g"), [], [F.col("id")]).collect()] == ["LGBTQ+", "Kids", "Family"]


def test_explode_packed_rows(spark):
    df = spark.createDataFrame([("a", "Music,Music", "v", 1), ("b", None, "v", 1), ("c", " ", "v", 1)], "id string, g string, value string, pos int")
    got = explode_packed(df, F.col("g"), NAMES, [F.col("id")]).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [("a", 1, "Music"), ("a", 2, "Music")]


def test_units_and_readings():
    r = QuantityReader()
    g = r.grammar
    assert g.read("min").dimension == "time" and g.read("pt").dimension == "count" and g.read("km").factor == 1000
    assert g.read("kg m^2").powers == (("length", 2), ("mass", 1)) and g.read("nonsense") is None
    ratio = {"3.5/5": (Fraction(7, 2), 5), "★★½☆": (Fraction(5, 2), 4), "95 per cent": (95, 100), "Two and a half stars out of four": (Fraction(5, 2), 4), "7,5 sur 20": (Fraction(15, 2), 20), "Rating: 1/10": (1, 10)}
    for text, want in ratio.items():
        x = r.read(text)
        assert (x.kind, x.value, x.scale) == ("ratio", *want), text
    assert r.read("b minus").grade == "B-" and r.read("8 pts").kind == "bare"
    assert {r.read(t).kind for t in ("NR", "", "?", "see review", "-3/5")} == {"none"}


def test_numbers_of_any_size_and_in_words():
    r = QuantityReader()
    words = {"thirteen out of twenty": (13, 20), "Forty-two of sixty": (42, 60), "a hundred and twelve of 200": (112, 200), "nineteen and a half / fifty": (Fraction(39, 2), 50), "3000000000000.25/4000000000000": (Fraction(12000000000001, 4), 4 * 10**12), "ninety percent": (90, 100)}
    for text, want in words.items():
        assert (r.read(text).value, r.read(text).scale) == want, text
    assert {r.read(t).kind for t in ("forty forty of fifty", "hundred hundred", "twenty zero / 30", "12 percent out of 100")} == {"none"}
    assert r.scale_in_text(Fraction(7), "I'd call it 7 on a (scale) of **10**.") == 10
    assert r.scale_in_text(Fraction(4), "One out of seven left.(4 \"out\" of 5 from me)") == 5 and r.scale_in_text(Fraction(1), "1.5 out of 6, 11/20") is None


def test_common_scale_sources_of_the_scale(spark):
    rows = [("a", "3", "My rating: 3 out of 4.", 10), ("b", "3", "no", 10), ("c", "3", None, None), ("d", "6/5", None, None), ("e", "1/0", None, None), ("f", "a-", None, None), ("g", None, "3/4", 5), ("h", "1/3", "", None), ("i", "2", "*2*  on a scale\nof 8", None), ("i", "2", "*2*  on a scale\nof 8", None), ("j", "H", "", 1), ("k", "2" + "0" * 30 + "/4" + "0" * 30, None, None)]
    df = spark.createDataFrame(rows, "k string, q string, text string, score int")
    grades = spark.createDataFrame([("A-", 91)], "grade string, pct int")
    got = sorted((r.k, r.score) for r in to_common_scale(df, keep=[F.col("k")], quantity=F.col("q"), text=F.col("text"), fallback=F.col("score"), grades=grades).collect() if r.score is not None)
    assert got == [("a", 750), ("b", 300), ("f", 910), ("h", 333), ("i", 250), ("i", 250), ("k", 500)]


def test_eager_join_equals_plain_join(spark):
    nan = float("nan")
    left = spark.createDataFrame([(" A", 0.5, 1), ("a", nan, 1), ("a", None, 1), ("b", 1.0, 1), (None, 0.1, 1)], "id string, v double, left_rows int")
    right = spark.createDataFrame([("a", 10.0), ("a", None), ("c", 1.0), (None, 5.0)], "id string, w double")
    s = eager_join_aggregate(left, right, key_text("id"), F.col("id"), [Measure("v", F.col("v"))], [Measure("w", F.col("w"))])
    got = {r.id: r for r in s.collect()}
    assert (got["a"].left_rows, got["a"].right_rows, got["a"].join_rows, got["a"].v_n, float(got["a"].v_join_sum), float(got["a"].w_join_sum)) == (3, 2, 6, 1, 1.0, 30.0)
    assert got["b"].join_rows == 0 and got[None].join_rows == 0 and "c" not in got
    assert {r.id for r in heavy_from_states(s, "id", "left_rows", 40).collect()} == {"a"}
    assert s.limit(0).count() == 0


def test_sums_over_the_join_are_exact(spark):
    left = spark.createDataFrame([("a", 0.00000001), ("a", 123456789.12345678), ("b", -0.00000003)], "id string, v double")
    right = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), ("b",)], "id string")
    s = eager_join_aggregate(left, right, F.col("id"), F.col("id"), [Measure("v", F.col("v"))])
    assert {r.id: r.v_join_sum for r in s.collect()} == {"a": Decimal("246913578.24691358"), "b": Decimal("-9E-8")}


def test_heavy_ids_come_through_the_joined_states(spark, monkeypatch):
    from grainfold import catalog_data

    plans = []
    monkeypatch.setattr(catalog_data, "written", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    catalog_data.p7_found(spark, "/root/testdata/sf0.001").collect()
    assert "Join LeftOuter" in plans[0] and "audience_score" in plans[0] and plans[0].count("sentiment_conf") > 1


def test_heavy_keys_are_bounded(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, "x").otherwise(F.col("id").cast("string")).alias("k"))
    assert [(r.k, r.rows) for r in heavy_keys(df, "k", 0.1).collect()] == [("x", 400)]
