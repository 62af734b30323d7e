import random
import re
from dataclasses import replace
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from grainfold.llm import copies, leaks, mixing, neardup, splitting, textvec, tokens
from grainfold.llm.topn import top_n

W = re.compile(r"[^\W_]+")


def test_words_and_hashes_match_plain_python():
    texts = ["", "  ", "Hello, World", "hello world", "HELLO\nworld!", "x_y z", "Straße 12", "a​b", "..."]
    b = textvec.Batch(texts)
    words, counts = b.words()
    assert counts.tolist() == [len(W.findall(t)) for t in texts]
    seq = textvec.sequence_hash(words, counts)
    assert seq[2] == seq[3] == seq[4] and len(set(seq[4:8].tolist())) == 4
    h1, h2, kept = b.canonical()
    assert h1[2] == h1[4] and h2[2] == h2[3] and kept.tolist() == [0, 0, 10, 10, 10, 3, 8, 2, 0] and h1[0] == h1[8]
    runs, n = textvec.word_runs(words, counts, 2)
    assert n.tolist() == [max(0, c - 1) for c in counts] and len(runs) == n.sum()


def rows_of(spark, rows, *extra):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "k string, g string, t string, `first` string, copies int")


def test_formatting_copies(spark):
    rows = [
        ("a1", "m", "Two words, here."), ("a0", "m", "two  WORDS here"), ("a2", "n", "two words here"), ("a3", None, "two words here"), ("a4", "m", None),
        ("b1", "m", "Story: a b; Mood: c"), ("b2", "m", "mood: C | story: A b"), ("b3", "m", "Mood: c Story: a b"),
        ("c1", "m", ""), ("c2", "m", "..."), ("d1", "m", "long " * 30_000), ("d2", "m", "LONG\n" * 30_000),
    ]
    df = rows_of(spark, rows)
    got = sorted(tuple(r) for r in copies.formatting_copies(df, F.col("k"), F.col("g"), F.col("t")).collect())
    assert got == [("a0", "a1"), ("b1", "b2"), ("b1", "b3"), ("c1", "c2"), ("d1", "d2")]
    n = {r.key: r.copies for r in copies.collapse(df, F.col("k"), F.col("g"), F.col("t")).collect()}
    assert n == {"a0": 2, "a2": 1, "b1": 3, "c1": 2, "d1": 2}
    assert copies.formatting_copies(df.limit(0), F.col("k"), F.col("g"), F.col("t")).count() == 0


def test_two_pointer_comparison():
    assert copies.same_when_folded("A b-c", "ab C!") and not copies.same_when_folded("ab", "abc") and copies.same_when_folded("a" * 200 + "B c", "a" * 200 + "b, C")
    assert copies.same_parts("A: x; B: y", "b: Y|a: X") and not copies.same_parts("A: x; B: y", "A: x; A: x") and copies.same_parts("A: x; B: y", "*B: y* _|_ A: _x_")


def test_copies_with_colliding_hashes_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        parts = [f"{n}: a {rng.choice('xy')}" for n in rng.sample(["Story", "Mood", "Look"], rng.choice([2, 3]))]
        form = rng.choice(["; ", " | ", "\n", " ", " _|_ "]).join(parts)
        rows.append((f"k{i:03}", f"m{i % 2}", form.upper() if i % 3 else form))
    # By hand: rows are alike if their letters or their sorted parts are, and so on from row to row.
    names = {}
    for k, g, t in rows:
        fold = lambda x: "".join(W.findall(x.lower()))
        bits = re.split(r"[;|\n]", t)
        names[k] = {(g, fold(t))} | ({(g, tuple(sorted(map(fold, bits))))} if len(bits) > 1 else set())
    first = {k: k for k in names}
    for _ in names:
        for a in names:
            for b in names:
                if names[a] & names[b]:
                    first[a] = first[b] = min(first[a], first[b])
    want = {(f, k) for k, f in first.items() if f != k}
    df = rows_of(spark, rows)
    assert len(want) > 20
    for bits in (64, 1):
        assert {tuple(r) for r in copies.formatting_copies(df, F.col("k"), F.col("g"), F.col("t"), bits).collect()} == want


def brute_pairs(rows, run, num, den, least):
    own = [(k, g, W.findall(t.lower())) for k, g, t in rows if t]
    own = [(k, g, w, {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}) for k, g, w in own if len(w) >= least]
    out = set()
    for i, a in enumerate(own):
        for b in own[:i]:
            copy = a[1] is not None and a[1] == b[1] and "".join(a[2]) == "".join(b[2])
            if len(a[3] & b[3]) * den >= len(a[3] | b[3]) * num and not copy:
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def test_near_duplicates_find_edits_and_reordering(spark):
    rng = random.Random(5)
    rows = []
    for f in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(40)]
        for v in range(4):
            w = list(base)
            if v:
                w[rng.randrange(40)] = f"typo{f}{v}"
            if v == 2:
                w = w[20:] + w[:20]
            rows.append((f"k{f}_{v}", f"m{f % 7}" if f % 5 else None, " ".join(w)))
    rows += [("c1", "m1", rows[0][2]), ("c2", "m2", rows[0][2]), ("short", "m", "a b c"), ("null", "m", None)]
    df = rows_of(spark, rows)
    want = brute_pairs(rows, 3, 1, 2, 20)
    for block in (8192, 3):
        s = neardup.Similarity(run=3, at_least=Fraction(1, 2), min_words=20, block=block)
        n = neardup.near_duplicates(df, F.col("k"), F.col("g"), F.col("t"), s)
        got = {tuple(r) for r in neardup.expand_pairs(n).collect()}
        assert not got - want and len(want - got) <= 0.01 * len(want)
    for block in (8192, 3):
        every = neardup.near_duplicates(df, F.col("k"), F.col("g"), F.col("t"), replace(s, exact=True, block=block))
        assert {tuple(r) for r in neardup.expand_pairs(every).collect()} == want
    classes = {r.key: r["class"] for r in neardup.duplicate_classes(n).collect()}
    assert len({classes[f"k3_{v}"] for v in range(4)}) == 1 and classes["k3_0"] != classes["k4_0"] and classes["c1"] == classes["k0_0"]
    empty = neardup.near_duplicates(df.limit(0), F.col("k"), F.col("g"), F.col("t"), s)
    assert neardup.expand_pairs(empty).count() == 0 and neardup.duplicate_classes(empty).count() == 0


def test_lists_stay_short_however_many_texts():
    s = neardup.Similarity(run=3, at_least=Fraction(1, 2), min_words=20)
    assert neardup.fitted(s, 10**6) == s
    for n in (10**9, 10**12):
        own = neardup.fitted(s, n)
        assert n <= own.crowd * 256**own.rows and neardup.miss_chance(own) <= neardup.miss_chance(s) < 0.07


def test_components_of_a_chain(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a <> 30")
    got = {r.doc: r["class"] for r in neardup.components(links).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in range(31, 61)} == {31}


def test_top_n_ties_nulls_and_skew(spark):
    nan = float("nan")
    rows = [("a", "g", 1.0), ("b", "g", 1.0), ("c", "g", nan), ("d", "g", None), ("e", "g", 0.5), ("f", None, 1.0), ("z", "h", 0.1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k string, g string, s double, rnk int")
    got = sorted((r.grp, r.rnk, r.item) for r in top_n(df, F.col("g"), F.col("s"), F.col("k"), 2).collect())
    assert got == [("g", 1, "a"), ("g", 2, "b"), ("h", 1, "z")]
    plan = top_n(df, F.col("g"), F.col("s"), F.col("k"), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1


def test_leaks_equal_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([5, 13, 20, 40])))) for i in range(20)] + [(90, None), (91, "")]
    docs = []
    for d in range(60):
        w = rng.choices(vocab, k=rng.randrange(0, 60))
        p = W.findall(items[rng.randrange(20)][1] or "")
        a = rng.randrange(max(1, len(p) - 10))
        docs.append((d, ", ".join(w + [x.upper() for x in p[a : a + rng.randrange(8, 30)]] + w)))
    docs += [(100, None), (101, ""), (102, docs[0][1])]
    grams = {}
    for i, p in items:
        w = W.findall((p or "").lower())
        for j in range(len(w) - 12):
            grams.setdefault(tuple(w[j : j + 13]), set()).add(i)
    want = set()
    for d, t in docs:
        w = W.findall((t or "").lower())
        for j in range(len(w) - 12):
            want |= {(d, i) for i in grams.get(tuple(w[j : j + 13]), ())}
    dd = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("term", F.lit("x"))
    ii = spark.createDataFrame(items, "item_id bigint, passage string").withColumn("around", F.lit(1))
    for s in (leaks.LeakSearch(), leaks.LeakSearch(block_words=60, piece_chars=120)):
        got = leaks.leaks(dd, F.col("doc_id"), F.col("text"), ii, F.col("item_id"), F.col("passage"), s)
        assert {(r.doc_id, r.item_id) for r in got.where("kind = 'phrase'").collect()} == want and want
    assert leaks.leaks(dd.limit(0), F.col("doc_id"), F.col("text"), ii, F.col("item_id"), F.col("passage")).count() == 0


def near_by_brute_force(docs, items, run=13, share=0.8):
    """{(doc, item): most words} by trying every place of every passage at every place of every document."""
    found, wing = {}, run - 1
    for d, t in docs:
        w = W.findall((t or "").lower())
        for i, p in items:
            v = W.findall((p or "").lower())
            for a in range(len(v) if len(v) >= run else 0):
                own = set(v[max(0, a - wing) : a + wing + 1])
                for b in range(len(w)):
                    if w[b] == v[a] and (n := len(own & set(w[max(0, b - wing) : b + wing + 1]))) >= len(own) * share:
                        found[d, i] = max(n, found.get((d, i), 0))
    return found


def test_near_leaks_without_their_rare_words_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(90)]
    passages = [rng.choices(vocab, k=rng.choice([12, 13, 14, 26, 50])) for _ in range(25)]
    items, docs = [], []
    for i, p in enumerate(passages):
        names = {j: f"name{i}x{j}" for j in range(rng.randrange(9), len(p), rng.choice([8, 9, 12]))}  # only the passage has them
        items.append((i, " ".join(names.get(j, w) for j, w in enumerate(p))))
        for c in range(3):
            edited = [rng.choice(vocab) if j in names or rng.random() < c / 20 else w for j, w in enumerate(p)]
            rng.shuffle(edited[:4])
            docs.append((10 * i + c, " ".join(rng.choices(vocab, k=rng.randrange(30)) + edited + rng.choices(vocab, k=rng.randrange(30)))))
    docs += [(900, None), (901, ""), (902, "v1 v2"), (903, " ".join(passages[3] + passages[4]))]
    want = near_by_brute_force(docs, items)
    dd = spark.createDataFrame(docs, "doc_id bigint, text string")
    ii = spark.createDataFrame(items, "item_id bigint, passage string")
    for s, table in ((leaks.LeakSearch(), leaks._TABLE), (leaks.LeakSearch(block_words=100), 997)):
        monkeypatch.setattr(leaks, "_TABLE", table)
        got = leaks.leaks(dd, F.col("doc_id"), F.col("text"), ii, F.col("item_id"), F.col("passage"), s).collect()
        assert {(r.doc_id, r.item_id) for r in got} >= set(want) and len(want) > 25
        assert {(r.doc_id, r.item_id): r.words for r in got if r.kind == "near"} == {k: n for k, n in want.items() if k not in {(r.doc_id, r.item_id) for r in got if r.kind == "phrase"}}


def test_leaks_across_pieces_with_few_words(spark):
    passage = [f"w{i}" for i in range(30)]
    sparse = lambda words: (" " * 40).join(words)
    dd = spark.createDataFrame([(1, sparse(passage[:13])), (2, sparse(passage[3:17])), (3, sparse(passage[:12])), (4, sparse([*passage[:25:2], *passage[1:25:2]]))], "doc_id bigint, text string")
    ii = spark.createDataFrame([(7, " ".join(passage))], "item_id bigint, passage string")
    run = lambda s: {tuple(r) for r in leaks.leaks(dd, F.col("doc_id"), F.col("text"), ii, F.col("item_id"), F.col("passage"), s).collect()}
    whole = run(leaks.LeakSearch())
    assert {(1, 7, "phrase", 13), (2, 7, "phrase", 14)} <= whole and {r[0] for r in whole if r[2] == "near"} >= {4}
    assert run(leaks.LeakSearch(piece_chars=150)) == whole


def test_pieces_cover_the_text(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    long_ = "\n\n".join(". ".join(" ".join(word() for _ in range(12)) for _ in range(8)) + "." for _ in range(30))
    docs = [(1, long_), (2, "short text"), (3, ""), (4, None), (5, "é" * 3000), (6, "x" * 5000 + " end"), (7, "  lead\n\n\n" + long_ + "  "), (8, "größe\u00a0 und " + long_.replace(" ", "\u00a0 "))]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, piece int")
    e = tokens.encoding(tokens.default_path())
    for s in (splitting.Split(), splitting.Split(limit=100, overlap=10, range_bytes=700, halo=200)):
        by = {}
        for r in splitting.split_texts(df, F.col("doc_id"), F.col("text"), s).collect():
            by.setdefault(r.doc_id, []).append(r)
        assert set(by) == {1, 2, 5, 6, 7, 8} and len(by[2]) == 1
        check_pieces(docs, by, s, e)
    small = splitting.Split(range_bytes=700, halo=200)
    total = {r.doc_id: r.tokens for r in splitting.token_totals(df, F.col("doc_id"), F.col("text"), small).collect()}
    assert total == {d: len(e.encode_ordinary(t)) for d, t in docs if t}
    own = {}
    for r in splitting.own_stretches(splitting.split_texts(df, F.col("doc_id"), F.col("text"), small)).orderBy("piece").collect():
        own[r.doc_id] = own.get(r.doc_id, "") + r.body
    assert own == {d: t for d, t in docs if t}


def check_pieces(docs, by, s, e):
    for d, t in docs:
        raw = (t or "").encode()
        ps = sorted(by.get(d, []), key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(1, len(ps) + 1))
        for a, b in zip(ps, ps[1:]):
            assert a.first < b.first <= a.last < b.last
            if d in (1, 7, 8):
                assert s.overlap <= len(e.encode_ordinary(raw[b.first : a.last].decode())) <= s.overlap + 12 and raw[a.last : a.last + 1].isspace()
        if ps:
            assert ps[0].first == 0 and ps[-1].last == len(raw) and all(p.body == raw[p.first : p.last].decode() and len(e.encode_ordinary(p.body)) <= s.limit for p in ps)


def test_files_are_read_by_ranges(spark, tmp_path):
    rng = random.Random(4)
    texts = {1: " ".join(rng.choices(["word", "straße", "end.", "x\n\ny"], k=4000)), 2: "", 3: "z" * 9000 + " tail of words" * 300, 4: "short"}
    for i, t in texts.items():
        (tmp_path / f"{i}.txt").write_text(t, encoding="utf-8")
    files = spark.createDataFrame([(i, f"file://{tmp_path}/{i}.txt", "x") for i in texts] + [(9, None, "x")], "doc_id bigint, uri string, body string")
    s = splitting.Split(limit=100, overlap=10, range_bytes=2000, halo=300)
    by = {}
    for r in splitting.split_files(files, F.col("doc_id"), F.col("uri"), s).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {1, 3, 4}
    check_pieces([(i, t) for i, t in texts.items() if i != 3], by, s, tokens.encoding(tokens.default_path()))
    assert sorted(by[3], key=lambda r: r.piece)[-1].last == len(texts[3]) and {r.doc_id: r.n for r in splitting.own_stretches(splitting.split_files(files, F.col("doc_id"), F.col("uri"), s)).groupBy("doc_id").agg(F.sum(F.length("body")).alias("n")).collect()} == {i: len(t) for i, t in texts.items() if t}


def test_mixture_meets_targets_and_caps(spark):
    rng = random.Random(11)
    docs = [(i, ("big", "mid", "small")[min(2, i % 11 // 4)], " ".join(rng.choices(["a", "b", "c"], k=rng.randrange(5, 60)))) for i in range(600)]
    docs += [(1000, None, "a b c"), (1001, "other", "b"), (1002, "big", None), (1003, "big", ""), (1004, " ", "c c")]
    t = [("big", 0.2, 1), ("mid", 0.3, 2), ("small", 0.5, 6), ("none", 0.4, 3), ("zero", 0.0, 1), (None, 0.1, 1)]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id bigint, source string, text string, rate double")
    tt = spark.createDataFrame(t, "source string, target_share double, max_repeats int")
    m = mixing.mix(df, F.col("doc_id"), F.col("source"), F.col("text"), tt)
    share = {r.source: r for r in m.shares.collect()}
    for n, want in (("big", 0.2), ("mid", 0.3), ("small", 0.5), ("none", 0.0), ("zero", 0.0)):
        assert abs(share[n].target_share - want) < 1e-9 and abs(share[n].expected_share - want) < 1e-4 and abs(share[n].actual_share - want) < 0.001
    rates = m.rates.collect()
    for parts in (1, 4, 16):
        again = mixing.mix(df.repartition(parts), F.col("doc_id"), F.col("source"), F.col("text"), tt)
        assert {tuple(r) for r in again.rates.collect()} == {tuple(r) for r in rates}
    cap = {"big": 1, "mid": 2, "small": 6}
    assert len(rates) == 603 and all(0 <= r.repeats <= cap.get(r.source, 3) and r.rate <= 6 for r in rates)
    assert mixing.mix(df.limit(0), F.col("doc_id"), F.col("source"), F.col("text"), tt).rates.count() == 0
    assert mixing.mix(df, F.col("doc_id"), F.col("source"), F.col("text"), tt.limit(0)).shares.count() == 0


def test_whole_copies_meet_the_tokens_of_the_rates():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 2000):
        size, rate = rng.integers(1, 4000, n), rng.uniform(0, 3, n)
        k = mixing.round_rates(rate, size, 3)
        assert (k >= 0).all() and (k <= 3).all() and abs((k * size).sum() - (rate * size).sum()) <= (1.5 if n > 3 else size.min())
    assert (mixing.round_rates(np.full(3, 0.23), np.array([4000, 900, 290]), 4) * [4000, 900, 290]).sum() == 1190


def test_classifier_learns_from_all_labelled_rows(spark):
    rng = random.Random(2)
    rows = [(c, " ".join(rng.choices([f"s{c}", f"t{c}", "x", "y"], k=30))) for c in (0, 1, 2) for _ in range(60)]
    m = mixing.Mix()
    w = mixing.fit_classifier(spark.createDataFrame(rows, "cls int, text string"), 3, m)
    held = [(c, " ".join(rng.choices([f"s{c}", f"t{c}", "x", "y"], k=30))) for c in (0, 1, 2) for _ in range(20)]
    p = mixing.posteriors([t for _, t in held], w, m)
    assert np.mean(p.argmax(1) == [c for c, _ in held]) > 0.95 and abs(p.sum(1) - 1).max() < 1e-9


def test_classes_hold_every_row(spark):
    words = [f"w{i}" for i in range(60)]
    text = lambda a, b: " ".join(words[a:b])
    rows = [("a1", text(0, 30)), ("a2", text(1, 31)), ("b1", text(30, 60)), ("c1", "too short"), ("d1", None), ("e1", "")]
    df = spark.createDataFrame(rows, "k string, t string").withColumn("g", F.lit("m"))
    s = neardup.Similarity(run=3, at_least=Fraction(1, 2), min_words=20)
    got = {r.key: r for r in neardup.duplicate_classes(neardup.near_duplicates(df, F.col("k"), F.col("g"), F.col("t"), s)).collect()}
    assert set(got) == {k for k, _ in rows}
    assert got["a1"]["class"] == got["a2"]["class"] != got["b1"]["class"] and got["b1"]["class"] is not None
    assert [got[k]["class"] for k in ("c1", "d1", "e1")] == [None] * 3
    assert {k: r.links for k, r in got.items()} == {"a1": 1, "a2": 1, "b1": 0, "c1": 0, "d1": 0, "e1": 0}
