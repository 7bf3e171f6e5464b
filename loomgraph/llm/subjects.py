"""Subject areas of documents by class-association rules.

Sentences of labelled documents are transactions of words with a class.
Frequent item sets come from parallel FP-growth: frequent words are ranked, each
transaction sends every group of words the part that the group needs, and each
group grows its own tree.  Item sets have up to ``LONGEST`` words.  What a more
general rule makes needless is pruned while growing: a set that holds as often
as one of its parts, and whatever holds a word that decides alone.

A sentence goes to the subject for which its matching rules give clearly most
evidence, the log of the shrunk rule confidence over the subject's base rate.  A
document's evidence for a subject (whether it has several such sentences, and how
many against those on its main subject) becomes a probability by a logistic
calibration.  That is fitted on labelled documents held out in ``FOLDS`` parts:
the counts of an item set are kept by fold, so the rules without one fold come
from the same mining, and every labelled document is scored by rules that have
not seen it.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release

# labelled documents that rules are mined from at most, taken by the hash of their id
MAX_LABELLED = 20_000
GROUPS = 64
FOLDS = 4
# words of the longest item set
LONGEST = 4
LEAST_WORD, LEAST_SET, LEAST_DOCS = 4, 8, 3
WORD_CONFIDENCE, SET_CONFIDENCE, GAIN = 0.6, 0.8, 0.1
# sentences at the base rate that every rule is taken to have seen besides its own
PRIOR = 2.5
# a word of several subjects: how far each is above its base rate, and how much they hold together
SHARED_LIFT, SHARED_MASS = 1.7, 0.75
# by how much a sentence's evidence for its subject exceeds that for the next one
CLEAR = 1.3
LEAST_PROBABILITY = 0.5
# where the calibration starts, and how strongly it is drawn there: a subject of several sentences, and of four tenths as many as the main one
STIFF = 5.0
START = (-6.0, 4.0, 5.0)

_TOKEN = re.compile(r"[^\W\d_]+|[\n\r]|[.!?;](?=\s)")
_HUMP = re.compile(r"[^\W\d_]*?[a-zà-öø-ÿ](?=[A-ZÀ-ÖØ-Þ])|[^\W\d_]+")
# words kept in a worker's memo of spellings; it starts anew when full, which changes no result
MEMO = 500_000


def parts_of(token: str) -> tuple[str, ...]:
    """A run of letters as lower-case words, identifiers taken apart; single letters are no words."""
    return tuple(p.lower() for p in _HUMP.findall(token) if len(p) > 1)


def sentences(text: str | None, memo: dict | None = None, known: set[str] | None = None) -> Iterator[list[str]]:
    """Lower-case words of each sentence, of those ``known`` if given; null and empty texts have none.

    ``memo`` keeps spellings between calls with the same ``known``.
    """
    memo = {} if memo is None else memo
    now: list[str] = []
    for token in _TOKEN.findall(text or ""):
        got = memo.get(token)
        if got is None:
            if len(memo) >= MEMO:
                memo.clear()
            got = memo[token] = tuple(w for w in parts_of(token) if known is None or w in known) if token.isalpha() else False
        if got is False:
            if now:
                yield now
                now = []
        else:
            now.extend(got)
    if now:
        yield now


class Tree:
    """An FP-tree whose nodes count transactions per class."""

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.item: list[int] = [-1]
        self.counts: list[dict] = [{}]
        self.children: dict[tuple[int, int], int] = {}
        self.at: dict[int, list[int]] = defaultdict(list)

    def add(self, items: list[int], classes: dict) -> None:
        """Items in order of rank, most frequent first."""
        node = 0
        for x in items:
            key = (node, x)
            if key not in self.children:
                self.children[key] = len(self.item)
                self.at[x].append(len(self.item))
                self.parent.append(node)
                self.item.append(x)
                self.counts.append({})
            node = self.children[key]
            here = self.counts[node]
            for c, n in classes.items():
                here[c] = here.get(c, 0) + n

    def grow(self, least: int, longest: int, wanted: set[int] | None = None, alone: frozenset | None = None, tail: tuple[int, ...] = (), held: int = 0) -> Iterator[tuple[tuple[int, ...], dict]]:
        """Frequent item sets whose rarest item is in ``wanted``, with their class counts.

        Given ``alone``, what a more general rule makes needless is not grown: sets
        of several items that hold one of these, and whatever holds a set that
        occurs as often as that set without its most frequent item.
        """
        for x in list(self.at):
            if wanted is not None and x not in wanted:
                continue
            if tail and alone is not None and x in alone:
                continue
            total: dict = {}
            for n in self.at[x]:
                for c, k in self.counts[n].items():
                    total[c] = total.get(c, 0) + k
            times = sum(total.values())
            if times < least or (alone is not None and times == held):
                continue
            found = (x, *tail)
            yield found, total
            if len(found) < longest and not (alone is not None and x in alone):
                base = Tree()
                for n in self.at[x]:
                    path, up = [], self.parent[n]
                    while up > 0:
                        path.append(self.item[up])
                        up = self.parent[up]
                    base.add(path[::-1], self.counts[n])
                yield from base.grow(least, longest, None, alone, found, times)


def mine(transactions: DataFrame, least: int = LEAST_WORD, longest: int = 2, set_least: int = 0, set_share: float = 0.0, base: dict[str, float] | None = None) -> DataFrame:
    """Frequent item sets of ``transactions(doc_id, subject, words)``: ``words`` (array), ``subject``, ``fold``, ``n``.

    Words count once in a transaction and only if ``LEAST_DOCS`` documents have
    them, so that no long document makes rules of its own.  Each group of words
    gets, of every transaction that has one of its words, the part up to its
    rarest such word.  Sets of several words are given only with ``set_least``
    transactions and a subject that has ``set_share`` of them.  With the ``base``
    rates of the subjects, sets that a more general rule makes needless are not
    grown.  Counts are apart by the column ``fold``, if there is one.
    """
    spark = transactions.sparkSession
    fold = F.col("fold") if "fold" in transactions.columns else F.lit(0)
    transactions = transactions.select("doc_id", "subject", fold.cast("int").alias("fold"), "words")
    each = transactions.select("doc_id", "subject", F.explode(F.array_distinct("words")).alias("w")).groupBy("w", "subject", "doc_id").count()
    words = each.groupBy("w", "subject").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("docs"))
    words = words.groupBy("w").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.max(F.struct("n", "subject")).alias("most")).where((F.col("n") >= least) & (F.col("docs") >= LEAST_DOCS))
    # words of a bounded sample of documents
    ranked = words.orderBy(F.desc("n"), "w").collect()
    alone = frozenset(k for k, r in enumerate(ranked) if base and _shrunk(r.most.n, r.n, base[r.most.subject]) >= WORD_CONFIDENCE) if base is not None else None
    held = spark.sparkContext.broadcast(([r.w for r in ranked], alone))

    def send(batches):
        order = {w: k for k, w in enumerate(held.value[0])}
        for pdf in batches:
            out = []
            for subject, part, ws in zip(pdf.subject, pdf.fold, pdf.words, strict=True):
                items = sorted({order[w] for w in ws if w in order})
                done = set()
                for k in range(len(items) - 1, -1, -1):
                    g = items[k] % GROUPS
                    if g not in done:
                        done.add(g)
                        out.append((g, subject, part, items[: k + 1]))
            yield pd.DataFrame(out, columns=["g", "subject", "fold", "items"])

    def grow(key, pdf):
        names, alone_ = held.value
        tree = Tree()
        for subject, part, items in zip(pdf.subject, pdf.fold, pdf["items"], strict=True):
            tree.add([int(x) for x in items], {(subject, part): 1})
        out = []
        for found, total in tree.grow(least, longest, {x for x in tree.at if x % GROUPS == key[0]}, alone_):
            if len(found) > 1:
                by: Counter = Counter()
                for (s, _), n in total.items():
                    by[s] += n
                times = sum(by.values())
                if times < set_least or max(by.values()) < set_share * times:
                    continue
            out += [([names[x] for x in found], s, f, n) for (s, f), n in total.items()]
        return pd.DataFrame(out, columns=["words", "subject", "fold", "n"])

    sent = transactions.mapInPandas(send, "g int, subject string, fold int, items array<int>")
    return sent.groupBy("g").applyInPandas(grow, "words array<string>, subject string, fold int, n long")


def _shrunk(n: int, times: int, rate: float) -> float:
    """A rule's confidence after some sentences at the base rate."""
    return (n + PRIOR * rate) / (times + PRIOR)


def make_rules(counts: dict[tuple[str, ...], dict[str, int]], base: dict[str, float]) -> dict:
    """Pruned rules from the class counts of sorted item sets, each with its log evidence.

    ``word`` decides alone; ``sets`` holds longer rules under their first word;
    ``shared`` has the words of several subjects.
    """
    times = {x: sum(c.values()) for x, c in counts.items()}
    conf = {x: {s: _shrunk(n, times[x], base[s]) for s, n in c.items() if n} for x, c in counts.items() if times[x]}
    word: dict[str, tuple[str, float]] = {}
    shared: dict[str, dict[str, float]] = {}
    for x, c in conf.items():
        if len(x) > 1 or times[x] < LEAST_WORD:
            continue
        s, p = min(c.items(), key=lambda kv: (-kv[1], kv[0]))
        if p >= WORD_CONFIDENCE:
            word[x[0]] = (s, math.log(p / base[s]))
            continue
        high = {s: p for s, p in c.items() if p >= SHARED_LIFT * base[s] and p > 0.1}
        if len(high) > 1 and sum(high.values()) >= SHARED_MASS:
            shared[x[0]] = {s: math.log(p / base[s]) for s, p in high.items()}
    sets: dict[str, list[tuple[frozenset, str, float]]] = defaultdict(list)
    parts: set[str] = set()
    for x, c in sorted(conf.items()):
        if len(x) < 2 or times[x] < LEAST_SET or any(w in word for w in x):
            continue
        s, p = min(c.items(), key=lambda kv: (-kv[1], kv[0]))
        # needless if it says little more than a part of it
        general = max(conf.get(part, {}).get(s, 0.0) for k in range(1, len(x)) for part in combinations(x, k))
        if p >= SET_CONFIDENCE and p >= general + GAIN:
            sets[x[0]].append((frozenset(x[1:]), s, math.log(p / base[s])))
            parts.update(x)
    return {"word": word, "sets": dict(sets), "shared": shared, "known": set(word) | parts | set(shared), "calibration": START}


def score(text: str | None, rules: dict, memo: dict | None = None) -> dict[str, int]:
    """Sentences of a text on each subject.

    A sentence goes to the subject with clearly most evidence.  A sentence with
    no more than words of several subjects goes to that of them which other
    sentences of the text deal with.
    """
    word, sets, shared = rules["word"], rules["sets"], rules["shared"]
    found: Counter = Counter()
    open_: list[dict[str, float]] = []
    for ws in sentences(text, memo, rules["known"]):
        evidence: dict[str, float] = {}
        loose: dict[str, float] = {}
        here = set(ws)
        for w in here:
            if w in word:
                s, e = word[w]
                evidence[s] = evidence.get(s, 0.0) + e
            elif w in shared:
                for s, e in shared[w].items():
                    loose[s] = loose.get(s, 0.0) + e
        if not evidence and len(here) > 1:
            for w in here:
                for rest, s, e in sets.get(w, ()):
                    if rest <= here:
                        evidence[s] = evidence.get(s, 0.0) + e
        if evidence:
            if loose:
                for s in evidence:
                    evidence[s] += loose.get(s, 0.0)
            s = max(evidence, key=lambda k: (evidence[k], k))
            top = evidence[s]
            if len(evidence) == 1 or top > CLEAR * max(e for k, e in evidence.items() if k != s):
                found[s] += 1
                continue
            open_.append(evidence)
        elif loose:
            open_.append(loose)
    sure = dict(found)
    for some in open_:
        known = [(n, some[s], s) for s, n in sure.items() if s in some]
        if known:
            found[max(known)[2]] += 1
    return dict(found)


def features(n: int, top: int) -> tuple[float, float, float]:
    """A document's evidence: a constant, whether several sentences are on the subject, and their number against the main subject's."""
    return 1.0, float(n > 1), n / top


def calibrate(rows: list[tuple[int, int, bool, int]]) -> tuple[float, ...]:
    """Weights of ``features`` by logistic regression over ``(n, top, right, times)``, drawn to ``START``."""
    start = np.array(START)
    w = start.copy()
    if rows:
        x = np.array([features(n, top) for n, top, _, _ in rows])
        y = np.array([float(right) for _, _, right, _ in rows])
        times = np.array([float(k) for *_, k in rows])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (times * (y - p)) - STIFF * (w - start)
            step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + STIFF * np.eye(len(w)), slope)
            # short steps keep Newton's method on its way where the classes are all but apart
            w += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-9:
                break
    return tuple(float(v) for v in w)


def probabilities(text: str | None, rules: dict, memo: dict | None = None) -> dict[str, float]:
    """Calibrated probability of each subject that some sentence of the text is on."""
    found = score(text, rules, memo)
    top = max(found.values(), default=0)
    return {s: 1 / (1 + math.exp(-sum(a * b for a, b in zip(rules["calibration"], features(n, top), strict=True)))) for s, n in found.items()}


def subjects_of(text: str | None, rules: dict, memo: dict | None = None) -> list[str]:
    """Subjects that a text deals with, in order of their names."""
    return sorted(s for s, p in probabilities(text, rules, memo).items() if p >= LEAST_PROBABILITY)


def _cut(batches):
    for pdf in batches:
        memo: dict = {}
        out = [(i, s[0], f, ws) for i, s, f, t in zip(pdf.doc_id, pdf.labels, pdf.fold, pdf.text, strict=True) if len(s) == 1 for ws in sentences(t, memo)]
        yield pd.DataFrame(out, columns=["doc_id", "subject", "fold", "words"])


def _labelled(documents: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """``doc_id, labels, fold, text`` of about ``max_labelled`` labelled documents at most."""
    real = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("labels"))
    n = real.count()
    keep = real if n <= max_labelled else real.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    # the labelled sample is bounded by max_labelled
    texts = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(keep), "doc_id")
    return materialise(texts.select("doc_id", "labels", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold"), "text"))


def _held_out(texts: DataFrame, per_fold: list[dict]) -> DataFrame:
    """``subject, n, top, labelled`` for every subject found in, or given to, a labelled document by rules that have not seen it."""
    held = texts.sparkSession.sparkContext.broadcast(per_fold)

    def run(batches):
        memos: list[dict] = [{} for _ in held.value]
        for pdf in batches:
            out = []
            for given, f, t in zip(pdf.labels, pdf.fold, pdf.text, strict=True):
                found = score(t, held.value[f], memos[f])
                top = max(found.values(), default=0)
                given = set(given)
                out += [(s, found.get(s, 0), top, s in given) for s in sorted(given | set(found))]
            yield pd.DataFrame(out, columns=["subject", "n", "top", "labelled"])

    return texts.mapInPandas(run, "subject string, n int, top int, labelled boolean").groupBy("subject", "n", "top", "labelled").count()


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, longest: int = LONGEST) -> dict:
    """Calibrated rules from the labelled documents.

    Rules are mined from documents with exactly one label; all labelled ones
    calibrate.  Labels are few and partly wrong; rules need support and
    confidence, so stray ones do not count.  About ``max_labelled`` labelled
    documents are used at most, by the hash of their id.  Null ids, subjects and
    texts are left out.  Without labels there are no rules.  ``held_out`` of the
    result has ``(subject, n, top, labelled, documents)`` of the labelled
    documents by rules that have not seen them.
    """
    texts = _labelled(documents, labels, max_labelled)
    said = materialise(texts.mapInPandas(_cut, "doc_id long, subject string, fold int, words array<string>"))
    totals = {r.subject: r["count"] for r in said.groupBy("subject").count().collect()}
    total = sum(totals.values())
    base = {s: c / total for s, c in totals.items()}
    counts: dict[tuple[str, ...], list[tuple[str, int, int]]] = defaultdict(list)
    if totals:
        got = mine(said, LEAST_WORD, longest, LEAST_SET, SET_CONFIDENCE - 0.05, base).toArrow()
        for words, subject, fold, n in zip(*(got.column(c).to_pylist() for c in ("words", "subject", "fold", "n")), strict=True):
            counts[tuple(sorted(words))].append((subject, fold, n))

    def without(fold: int) -> dict:
        some: dict[tuple[str, ...], dict[str, int]] = {}
        for x, rows in counts.items():
            mine_ = some[x] = {}
            for s, f, n in rows:
                if f != fold:
                    mine_[s] = mine_.get(s, 0) + n
        return make_rules(some, base)

    rules = without(-1)
    seen = [(r.subject, r.n, r.top, r.labelled, r["count"]) for r in _held_out(texts, [without(f) for f in range(FOLDS)]).collect()] if totals else []
    rules["held_out"] = sorted(seen)
    rules["calibration"] = calibrate([(n, top, right, k) for _, n, top, right, k in rules["held_out"] if n])
    release(said)
    release(texts)
    return rules


def quality(rules: dict) -> list[tuple[str, int, int, int]]:
    """``subject, labelled, found, both``: documents by label and by rules that have not seen them."""
    sums: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    for s, n, top, right, k in rules["held_out"]:
        found = n > 0 and sum(a * b for a, b in zip(rules["calibration"], features(n, top), strict=True)) >= math.log(LEAST_PROBABILITY / (1 - LEAST_PROBABILITY))
        for at, is_so in enumerate((right, found, right and found)):
            sums[s][at] += k * is_so
    return [(s, *c) for s, c in sorted(sums.items())]


def classify(documents: DataFrame, rules: dict, keep: list[str] | None = None, measure: tuple[str, str, Callable] | None = None) -> DataFrame:
    """``doc_id, subjects`` (array, may be empty) and the columns ``keep``, for every document with an id.

    Null texts have no subject; rows with the same id are judged each on its
    own.  ``measure`` is a name, a type and a function of the text whose result
    is added, so that texts go to Python but once.
    """
    held = documents.sparkSession.sparkContext.broadcast({k: v for k, v in rules.items() if k != "held_out"})
    keep = [c for c in keep or [] if c not in ("doc_id", "subjects")]
    kinds = dict(documents.dtypes)

    def run(batches):
        memo: dict = {}
        for pdf in batches:
            out = pdf[["doc_id", *keep]].copy()
            out["subjects"] = [subjects_of(t, held.value, memo) for t in pdf.text]
            if measure:
                out[measure[0]] = [measure[2](t) for t in pdf.text]
            yield out

    schema = ", ".join(["doc_id long", *[f"`{c}` {kinds[c]}" for c in keep], "subjects array<string>", *([f"{measure[0]} {measure[1]}"] if measure else [])])
    return documents.where("doc_id is not null").select("doc_id", "text", *[c for c in keep if c != "text"]).mapInPandas(run, schema)
