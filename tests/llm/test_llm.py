"""The training-data operators against brute force, held-out labels and odd input."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import mixing, packing, parse_reports, subjects, tokens, tree_labels

REPORT = "file string, used_backend string, fallback_reason string, diagnostics_json string, parsed_at timestamp, loaded_at timestamp"


def test_reports(spark):
    import datetime as dt

    t = lambda h: dt.datetime(2025, 1, 1, h)
    cut = '[{"code":"UnexpectedEof","message":"expected \'}\' to close the body, found end of input","line":1}]'
    rows = [
        ("r/a.py", "x", None, cut, t(1), t(9)), ("./r/a.py", "x", None, "[]", t(2), t(3)),
        ("r/b.py", "x", None, "[]", t(1), t(3)), ("r/b.py", "x", "ripex: source is lua text under a python suffix", None, t(2), t(2)), ("r/b.py", "x", "ripex: source is lua text under a python suffix", None, t(2), t(2)),
        ("r/c.py", "x", None, '["3:1: unexpected \'<<<<<<<\' at start of line", "1:1: line 2 is longer', t(1), t(1)),
        ("r/d.py", "x", None, '[{"code":"Note","message":"string literal at line 3 contains \'<<<<<<<\'; kept as text"}]', t(1), t(1)),
        ("r/e.py", "x", "memory quota reached before parsing began", "null", None, None),
        ("r/f.py", None, None, '{"code": "E0107", "message": "some new complaint"}', t(1), None), ("r/g.py", "x", "", "not json at all", t(1), t(1)),
        (None, "x", "file ends inside a string literal", "[]", t(1), t(1)),
    ]
    df = spark.createDataFrame(rows, REPORT).withColumn("damage", F.lit("clash"))
    got = {r.file: r.damage for r in parse_reports.judge(df).collect()}
    assert got == {"r/a.py": None, "r/b.py": "foreign", "r/c.py": "conflict", "r/d.py": None, "r/e.py": None, "r/f.py": "corrupt", "r/g.py": None}
    files = spark.createDataFrame([("r/a.py", "py", 1), ("r/b.py", "Python", 2), ("r//b.py", "python", 1)], "path string, language string, snapshot_no int")
    rates = {(r.repo, r.language): (r.n_files, r.n_damaged) for r in parse_reports.damage_rates(df, files).collect()}
    assert rates == {("r", "python"): (2, 1), ("r", "unknown"): (5, 2)}
    assert parse_reports.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("path", "size", "lines", "label"),
    [
        ("r/src/a.py", 4000, 120, "handwritten"), ("r/vendor/lib/x/y.py", 4000, 120, "vendored"), ("r/src/vendor_portal/x.py", 4000, 120, "handwritten"), ("./r//third_party/z.c", 4000, 120, "vendored"), ("r\\lib\\zlib-1.2.3\\z.c", 4000, 120, "vendored"),
        ("r/dist/app.js", 4000, 120, "generated"), ("r/api/x.pb.go", 4000, 120, "generated"), ("r/src/build/x.py", 4000, 120, "handwritten"), ("r/build/x.cpp", 4000, 120, "generated"), ("r/package-lock.json", 4000, 120, "generated"),
        ("r/public/a.js", 90_000, 2, "minified"), ("r/public/a.min.js", 4000, 120, "minified"), ("r/src/minifier_x.js", 4000, 120, "handwritten"), ("r/src/one.js", 300, 1, "handwritten"), ("r/src/data.rs", 2_000_000, 30_000, "blob"), ("r/src/empty.py", 0, 0, "handwritten"), ("r/a/b/c/d/e/f/g/h/i/j/k.py", 900, 30, "handwritten"), ("r/n.py", None, None, "handwritten"),
    ],
)
def test_tree_labels_one_by_one(path, size, lines, label, labelled):
    assert labelled[path] == label


@pytest.fixture(scope="module")
def labelled(spark):
    mark = next(m for m in test_tree_labels_one_by_one.pytestmark if m.name == "parametrize")
    rows = [(p, s, n, "clash") for p, s, n, _ in mark.args[1]] + [(None, 1, 1, "x")]
    rows += rows[:3] + [(f"r/src/more{i}.py", 900, 30, "x") for i in range(30)] + [(f"r/api/x{i}.pb.go", 900, 30, "x") for i in range(30)] + [("r/api/plain.go", 900, 30, "x")]
    got = {r.path: r.label for r in tree_labels.label_files(spark.createDataFrame(rows, "path string, size long, line_count int, label string")).collect()}
    assert got["r/api/plain.go"] == "handwritten"
    spelt = {"./r//third_party/z.c": "r/third_party/z.c", "r\\lib\\zlib-1.2.3\\z.c": "r/lib/zlib-1.2.3/z.c"}
    return got | {k: got[v] for k, v in spelt.items()}


def test_tree_labels_of_nothing(spark):
    assert tree_labels.label_files(spark.createDataFrame([], "path string, size long, line_count int")).count() == 0


@pytest.mark.parametrize("capacity", [16, 100, 512])
def test_configurations(capacity):
    rng = random.Random(capacity)
    histogram = {}
    for _ in range(3000):
        s = min(capacity, max(1, int(rng.expovariate(6 / capacity))))
        histogram[s] = histogram.get(s, 0) + 1
    plan = packing.solve(histogram, capacity)
    used = {}
    for config, n in plan.runs:
        assert sum(s * k for s, k in config.items()) <= capacity
        for s, k in config.items():
            used[s] = used.get(s, 0) + k * n
    assert used == histogram
    assert plan.containers <= 1.02 * plan.bound + 1
    assert packing.solve({}, capacity).containers == 0


def test_knapsack_against_brute_force():
    import itertools

    import numpy as np

    sizes, worth = [3, 5, 7], [3.0, 5.5, 7.1]
    got = packing.price(20, np.array(sizes), np.array(worth), np.array([99.0, 99.0, 99.0]))
    best = max(sum(n * w for n, w in zip(c, worth, strict=True)) for c in itertools.product(range(7), range(5), range(3)) if sum(n * s for n, s in zip(c, sizes, strict=True)) <= 20)
    assert abs(sum(worth[k] * n for k, n in got.items()) - best) < 1e-9


def test_pack(spark):
    rng = random.Random(1)
    sizes = {i: rng.choice([1, 7, 30, 64, 65, 128, 300, 0]) for i in range(400)} | {1000 + i: 40 for i in range(300)}
    items = spark.createDataFrame([*sizes.items(), (9999, None)], "doc_id long, n_tokens long")
    rows = packing.pack(items, 64).collect()
    load, pieces = {}, {}
    for r in rows:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.piece_no, r.token_start, r.n_tokens))
    assert max(load.values()) <= 64
    for i, n in sizes.items():
        got = sorted(pieces[i])
        assert sum(x[2] for x in got) == n and len(got) == max(1, -(-n // 64))
        assert [x[1] for x in got] == [64 * k for k in range(len(got))]
    assert pieces[9999] == [(0, 0, 0)]
    assert packing.pack(items.limit(0), 64).count() == 0
    # each document and size appears twice, as items of their own
    twice = packing.pack(items.unionByName(items), 64)
    assert twice.count() == 2 * len(rows)


def test_rake_meets_sources_and_caps():
    cells = {("a", "en", "x"): 1000.0, ("a", "fr", "y"): 500.0, ("b", "en", "x"): 40.0, ("b", "fr", "x"): 10.0, ("c", "en", "y"): 900.0}
    made = mixing.rake(cells, {"a": (0.5, 1), "b": (0.2, 4), "c": (0.2, 2), "gone": (0.1, 9)})
    got = {}
    for c, w in made.weights.items():
        assert w <= {"a": 1, "b": 4, "c": 2}[c[0]] + 1e-9
        got[c[0]] = got.get(c[0], 0) + w * cells[c]
    assert {s: round(t / made.total, 6) for s, t in got.items()} == {"a": round(0.5 / 0.9, 6), "b": round(0.2 / 0.9, 6), "c": round(0.2 / 0.9, 6)}
    assert abs(got["b"] - 200) < 1e-6
    assert mixing.rake({}, {"a": (1.0, 1)}).weights == {}


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["a", "a", "a", "b", "z", None]), rng.choice(["en", "fr", None]), None, rng.randrange(0, 60)) for i in range(3000)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, language string, topic string, n_tokens long")
    targets = spark.createDataFrame([(" A", 0.6, 2), ("b", 0.3, 3), ("none", 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(sized, targets)
    shares = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    assert abs(shares["a"].actual_share - 0.6 / 0.9) < 0.005 and shares["none"].actual_share == 0
    assert shares["a"].most_copies <= 2 and shares["b"].most_copies <= 3
    assert {r.source for r in mixed.select("source").distinct().collect()} == {"a", "b"}
    assert mixing.mix(sized.limit(0), targets).count() == 0


def test_tokens(spark):
    pytest.importorskip("tiktoken")
    if not __import__("os").path.exists(tokens.TOKENIZER):
        pytest.skip("no vocabulary here")
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "x" * 50_000)], "i int, t string")
    got = {r.i: r.n_tokens for r in tokens.with_tokens(df, "t", ["i"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1000
    assert tokens.count("<|endoftext|>") > 1


def test_itemsets_against_brute_force(spark):
    from collections import Counter
    from itertools import combinations

    rng = random.Random(3)
    rows = [(i, rng.choice("AB"), rng.sample("pqrstuvw", rng.randrange(1, 6))) for i in range(120)]
    want = Counter()
    for _, s, ws in rows:
        for n in (1, 2):
            for x in combinations(sorted(ws), n):
                want[x, s] += 1
    total = Counter()
    for (x, _), n in want.items():
        total[x] += n
    got = {(tuple(sorted(r.words)), r.subject): r.n for r in subjects.mine(spark.createDataFrame(rows, "doc_id int, subject string, words array<string>"), 5).collect()}
    assert got == {k: n for k, n in want.items() if total[k[0]] >= 5}


def test_subjects_held_out(spark):
    rng = random.Random(4)
    terms = {"law": ["court", "verdict", "statute", "bar"], "music": ["violin", "opera", "tempo", "bar"], "food": ["noodle", "spice", "oven", "bar"]}
    filler = ["the job runs at night", "see the page for details", "values are clipped", "restart after changes"]

    def doc(subject, passing=None):
        said = [f"the {rng.choice(terms[subject])} comes before {rng.choice(terms[subject][:3])}" for _ in range(3)] + rng.sample(filler, 2)
        if passing:
            said.append(f"a {terms[passing][0]} is shown")
        rng.shuffle(said)
        return ". ".join(said) + "."

    docs, truth = [], {}
    for i in range(300):
        s = rng.choice(list(terms))
        other = rng.choice([x for x in terms if x != s])
        docs.append((i, doc(s, other if i % 3 == 0 else None)))
        truth[i] = [s]
    docs += [(1000, None), (1001, ""), (1002, ". ".join(filler))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("subjects", F.lit("clash"))
    labels = spark.createDataFrame([(i, truth[i][0] if i % 20 else "law") for i in range(150)] + [(None, "law"), (5, None)], "doc_id long, subject string")
    rules = subjects.fit(df, labels)
    got = {r.doc_id: r.subjects for r in subjects.classify(df, rules).collect()}
    held = range(150, 300)
    assert sum(got[i] == truth[i] for i in held) / 150 > 0.97
    assert got[1000] == got[1001] == got[1002] == []
    assert subjects.fit(df, labels.limit(0))["word"] == {}
