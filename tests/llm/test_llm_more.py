"""Longer item sets, calibration, packing against its bounds, mixing by topics and languages, and reports against the file's language."""

import random
from collections import Counter
from itertools import combinations

import pytest

from loomgraph.llm import mixing, packing, parse_reports, subjects


@pytest.mark.parametrize("longest", [3, 4])
def test_longer_itemsets_against_brute_force(spark, longest):
    rng = random.Random(longest)
    rows = [(i, rng.choice("AB"), i % 3, rng.sample("pqrstu", rng.randrange(1, 6)) * 2) for i in range(90)]
    want = Counter()
    for _, s, f, ws in rows:
        for n in range(1, longest + 1):
            for x in combinations(sorted(set(ws)), n):
                want[x, s, f] += 1
    total = Counter()
    for (x, _, _), n in want.items():
        total[x] += n
    mined = subjects.mine(spark.createDataFrame(rows, "doc_id int, subject string, fold int, words array<string>"), 7, longest)
    assert {(tuple(sorted(r.words)), r.subject, r.fold): r.n for r in mined.collect()} == {k: n for k, n in want.items() if total[k[0]] >= 7}


def test_pruned_growth_loses_no_rule(spark):
    rng = random.Random(9)
    # the pair p, q tells A from B, neither of them alone
    rows = [(i, "A" if ("p" in ws) == ("q" in ws) else "B", ws) for i in range(300) for ws in [["z", *rng.sample("pqrst", 3)]]]
    df = spark.createDataFrame(rows, "doc_id int, subject string, words array<string>")
    base = {s: n / 300 for s, n in Counter(s for _, s, _ in rows).items()}

    def rules(**how):
        counts = {}
        for r in subjects.mine(df, 4, 3, **how).collect():
            counts.setdefault(tuple(sorted(r.words)), {})[r.subject] = r.n
        return subjects.make_rules(counts, base)

    pruned, whole = rules(base=base), rules()
    assert pruned["word"] == whole["word"]
    assert {k: sorted(v, key=str) for k, v in pruned["sets"].items()} == {k: sorted(v, key=str) for k, v in whole["sets"].items()}
    assert any(rest == {"q"} and s == "A" for rest, s, _ in pruned["sets"]["p"])


def test_calibration_follows_the_labels():
    rows = [(1, 5, False, 60), (1, 2, False, 40), (2, 2, True, 80), (5, 5, True, 200), (2, 4, True, 30), (1, 9, False, 50), (2, 9, False, 25)]
    rules = {"calibration": subjects.calibrate(rows)}
    p = lambda n, top: sum(a * b for a, b in zip(rules["calibration"], subjects.features(n, top), strict=True))
    assert p(5, 5) > 0 and p(2, 4) > 0 and p(1, 2) < 0 and p(2, 9) < 0
    assert subjects.calibrate([]) == subjects.START


def test_words_of_identifiers():
    assert [list(s) for s in subjects.sentences("Call fooBar_bazQux! x yy\nHTTPServer 7 Überfall")] == [["call", "foo", "bar", "baz", "qux"], ["yy"], ["httpserver", "überfall"]]
    assert list(subjects.sentences(None)) == list(subjects.sentences("")) == []
    assert list(subjects.sentences("a court is. the bar", {}, {"court", "bar"})) == [["court"], ["bar"]]


def test_packing_against_its_bounds():
    hard = {510: 6000, 270: 6000, 260: 6000, 230: 12000}
    plan = packing.solve(hard, 1000)
    assert plan.bound == 9000 and plan.containers <= 9010 and plan.greedy == 11000 and plan.by_program > 0.95 * sum(hard.values())
    rng = random.Random(5)
    triples = {}
    for _ in range(20000):
        s = rng.randrange(400, 900, 7)
        triples[s] = triples.get(s, 0) + 1
    plan = packing.solve(triples, 2000)
    assert plan.bound <= plan.containers <= 0.96 * plan.greedy
    # a bound of the program above the volume: none of these fits beside another
    assert packing.solve({600: 10}, 1000).bound == 10
    small = packing.solve({3: 1, 7: 2}, 10)
    assert small.containers == small.bound == 2


def test_bounded_knapsack():
    import numpy as np

    rng = random.Random(6)
    for _ in range(20):
        sizes = np.array(sorted(rng.sample(range(1, 15), 4)))
        worth = np.array([rng.random() for _ in sizes])
        most = np.array([rng.randrange(0, 4) for _ in sizes], dtype=float)
        best = 0.0
        for a in range(4):
            for b in range(4):
                for c in range(4):
                    for e in range(4):
                        n = np.array([a, b, c, e])
                        if (n <= most).all() and (n * sizes).sum() <= 25:
                            best = max(best, float((n * worth).sum()))
        got = packing.price(25, sizes, worth, most)
        assert abs(sum(worth[k] * n for k, n in got.items()) - best) < 1e-9 and all(n <= most[k] for k, n in got.items())


def test_packing_of_several_capacities(spark):
    rng = random.Random(7)
    items = spark.createDataFrame([(i, rng.choice([0, 3, 9, 17, 40])) for i in range(300)], "doc_id long, n_tokens long")
    both, plans = packing.pack_all(items, [16, 32, 32])
    for c in (16, 32):
        rows = both.where(f"capacity = {c}").collect()
        load = Counter()
        for r in rows:
            load[r.container_id] += r.n_tokens
        assert max(load.values()) <= c and sum(load.values()) == sum(r.n_tokens for r in items.collect())
        assert sum(1 for r in rows if r.token_start % c or r.n_tokens > c) == 0
    assert set(plans) == {16, 32}
    assert packing.pack_all(items, [])[0].count() == 0


def test_mix_by_topics_and_languages(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice(["a", "b"]), rng.choice(["en", "fr", None]), rng.choice([["x"], ["x", "y"], [], None, ["y", None]]), rng.randrange(1, 40)) for i in range(3000)]
    docs += [(9000, "a", "en", ["x"], 9000), (9001, "a", "tlh", ["x"], 1)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, language string, topics array<string>, n_tokens long")
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 2)], "source string, target_share double, max_repeats int")
    rows = mixing.margins(sized, targets).collect()
    assert {r.name for r in rows if r.axis == "topic"} == {"x", "y", "other"} and {r.name for r in rows if r.axis == "language"} == {"en", "fr", "other"}
    assert max(abs(r.target_share - r.actual_share) for r in rows if r.axis == "source") < 0.002
    assert max(abs(r.target_share - r.actual_share) for r in rows) < 0.08
    assert mixing.margins(sized.limit(0), targets).count() == 0


def test_rake_of_several_topics():
    cells = {("a", "en", ("x", "y")): 100.0, ("a", "en", ("x",)): 300.0, ("b", "en", ("y",)): 400.0}
    made = mixing.rake(cells, {"a": (0.5, 2), "b": (0.5, 2)})
    assert made.topics == {"x": 350 / 800, "y": 450 / 800}
    got = Counter()
    for c, w in made.weights.items():
        got[c[0]] += w * cells[c]
    assert abs(got["a"] - got["b"]) < 1e-6


def test_reports_against_the_language(spark):
    rows = [("r/a.py", "x", "content reads like python and fails", None), ("r/b.rs", "x", "content reads like python and fails", None), ("r/c.rs", "x", "ripex: source is rust text under a rust suffix", None), ("r/d.go", "x", "0 of 7 lines accepted as go", None), ("r/e.go", "x", "no words that are known", None)]
    results = spark.createDataFrame([(*r, None, None) for r in rows], "file string, used_backend string, fallback_reason string, diagnostics_json string, parsed_at timestamp, loaded_at timestamp")
    files = spark.createDataFrame([("r/a.py", "Python", 1), ("./r/b.rs", "rs", 1), ("r/c.rs", "rust", 1), ("r/c.rs", None, 0)], "path string, language string, snapshot_no int")
    got = {r.file: (r.language, r.damage) for r in parse_reports.judge(results, files).collect()}
    assert got == {"r/a.py": ("python", None), "r/b.rs": ("rust", "foreign"), "r/c.rs": ("rust", None), "r/d.go": ("unknown", "foreign"), "r/e.go": ("unknown", None)}
    by = parse_reports.damage_by_backend(results, files).collect()
    assert [tuple(r) for r in by] == [("x", 5, 2, 0.4)]
