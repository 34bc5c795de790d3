"""Toxicity scores: Levenshtein automata over a lexicon trie, with context windows.

Lexicon. Learnt from a bounded sample of labelled rows: whole words and word stems
whose presence goes with the label, chosen by greedy cover, so that every language's terms
are found from its own labels.

Matching. All terms share one trie. A term of 5 letters or more may be misspelled: its
Levenshtein automaton (1 error, 2 from 9 letters) is run on the trie, and the
joint automaton's states (sets of trie node and errors) are determinised as words
are read, so a word costs one table look-up a letter.

Context. Each hit looks at a window of words around it. Inside quotation marks, or near a reporting
word, it counts as quoted; near a second-person word, as directed. A
logistic model over the counts, fitted with a prior that discounts quoted hits, gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounded_batches, text_or_empty

WORD = re.compile(r"\w+")
#: Words that report or mention speech, and words that address someone.
REPORTING = frozenset("said says say wrote writes quote quoted quoting called calls word term reported dit sagte dijo".split())
SECOND_PERSON = frozenset("you your yours yourself u ur tu toi vous votre du dich dir dein ihr usted ustedes vosotros".split())
QUOTES = "\"'“”‘’«»„"
FEATURES = ("direct", "directed", "quoted", "fuzzy", "fuzzy_quoted", "density")
#: Prior means of the weights, intercept last.
PRIOR = np.array([2.5, 0.5, 0.3, 1.0, 0.1, 0.5, -3.5])


def errors_allowed(term: str) -> int:
    return 0 if term.endswith("*") or len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """The joint automaton of all terms; a term that ends in ``*`` matches as the start of a word."""

    def __init__(self, terms: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.final: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)]  # errors allowed (-1: no word), strength as a word and as a stem
        self.most = [0]  # errors allowed by any term below
        for term, strength in terms.items():
            k, stem, node = errors_allowed(term), term.endswith("*"), 0
            self.most[0] = max(self.most[0], k)
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.final.append((-1, 0.0, 0.0))
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], k)
            was = self.final[node]
            self.final[node] = (was[0], was[1], strength) if stem else (k, strength, was[2])
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[int, float, float]] = []  # fewest errors and strength if the word ends here; strength of a stem read so far
        self.start = self.state({(0, 0)})
        self.words: dict[str, tuple[int, float]] = {}

    def state(self, items: set[tuple[int, int]]) -> int:
        todo, best = list(items), {}
        while todo:  # a missing letter: step into a child without reading
            node, e = todo.pop()
            if e > self.most[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = min(((e, -self.final[n][1]) for n, e in key if e <= self.final[n][0]), default=(9, 0.0))
            self.found.append((ends[0], -ends[1], max((self.final[n][2] for n, e in key if e == 0), default=0.0)))
        return self.states[key]

    def move(self, s: int, c: str) -> int:
        items: set[tuple[int, int]] = set()
        for node, e in self.sets[s]:
            if c in self.children[node]:
                items.add((self.children[node][c], e))
            items.add((node, e + 1))  # one letter too many
            items |= {(child, e + 1) for child in self.children[node].values()}  # another letter
        self.moves[s][c] = to = self.state(items)
        return to

    def look(self, word: str) -> tuple[int, float]:
        """Fewest errors between the word and a term within its allowance (9: none), and that term's strength."""
        found = self.words.get(word)
        if found is None:
            s, stem = self.start, 0.0
            for c in word:
                s = self.moves[s][c] if c in self.moves[s] else self.move(s, c)
                if not self.sets[s]:
                    found = (9, 0.0)
                    break
                stem = max(stem, self.found[s][2])
            else:
                found = self.found[s][:2]
            if stem and (found[0] or found[1] < stem):
                found = (0, stem)
            if len(self.words) > 100_000:
                self.words.clear()
            if len(self.sets) > 20_000:
                self.states.clear(), self.sets.clear(), self.moves.clear(), self.found.clear()
                self.start = self.state({(0, 0)})
            self.words[word] = found
        return found


def features(text: str, matcher: Matcher, window: int = 5) -> list[float]:
    low = text.lower()
    words = WORD.findall(low)
    hits = {w: found for w in set(words) if (found := matcher.look(w))[0] < 9}
    n = dict.fromkeys(FEATURES, 0.0)
    if hits:
        spans = [m.span() for m in WORD.finditer(low)]
        for i, w in enumerate(words):
            if w in hits:
                a, b = spans[i]
                near = words[max(0, i - window) : i] + words[i + 1 : i + 1 + window]
                quoted = (low[a - 1 : a] in QUOTES and low[b : b + 1] in QUOTES and a > 0 and b < len(low)) or not REPORTING.isdisjoint(near)
                errors, strength = hits[w]
                n[("fuzzy_quoted" if quoted else "fuzzy") if errors else ("quoted" if quoted else "direct")] += strength
                n["directed"] += not quoted and not SECOND_PERSON.isdisjoint(near)
        n["density"] = (n["direct"] + n["fuzzy"]) / len(words) * 100
    return [math.log1p(n[k]) for k in FEATURES]


def learn_lexicon(texts: list[str], toxic: list[int], most_terms: int = 400, least: int = 3, least_lift: float = 5.0) -> dict[str, float]:
    """Terms and their strengths (0 to 1): a greedy cover of the toxic rows by words and stems that clean rows seldom hold.

    The lift of a term is the ratio of its document rates in toxic and clean rows. A
    term is taken while it covers more rows that no term covers yet than its rate in clean rows
    explains; its strength is a third of the lift's log10.
    """
    known: dict[str, str] = {}  # equal words of different texts are one string
    docs = [{known.setdefault(w, w) for w in WORD.findall(t.lower()) if not w.isdigit()} for t in texts]
    known.clear()
    grams = lambda words: set(words) | {w[:k] + "*" for w in words for k in range(4, min(9, len(w)) + 1)}
    # most grams are in one row only: they are counted before sets are kept for the others
    rows: Counter = Counter()
    for words, y in zip(docs, toxic, strict=True):
        if y:
            rows.update(grams(words))
    often = {g for g, n in rows.items() if n >= least}
    del rows
    holds: dict[str, set[int]] = defaultdict(set)
    for i, (words, y) in enumerate(zip(docs, toxic, strict=True)):
        if y:
            for g in grams(words) & often:
                holds[g].add(i)
    clean: Counter = Counter()
    for words, y in zip(docs, toxic, strict=True):
        if not y:
            clean.update(g for g in grams(words) if g in holds)
    n_toxic, n_clean = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    lift = {g: (len(ids) / n_toxic) / ((clean[g] + 0.5) / n_clean) for g, ids in holds.items()}
    good = {g: ids for g, ids in holds.items() if lift[g] >= least_lift}
    terms: list[str] = []
    expected = {g: clean[g] * n_toxic / n_clean for g in good}
    for floor, sure in ((least, least_lift), (5 * least, 2 * least_lift)):  # the second cover finds other terms of rows that one term covers
        akin = lambda g: any(g.rstrip("*").startswith(t.rstrip("*")) or t.rstrip("*").startswith(g.rstrip("*")) for t in terms)  # noqa: B023, E731
        left = {i for i, y in enumerate(toxic) if y}
        pool = {g: ids for g, ids in good.items() if len(ids) >= floor and lift[g] >= sure and not akin(g)}
        while pool and len(terms) < most_terms:
            gain = lambda g: (len(pool[g] & left) - 1.5 * expected[g], not g.endswith("*"), len(g), g)  # noqa: B023, E731
            best = max(pool, key=gain)
            if len(pool[best] & left) - 1.5 * expected[best] < floor:
                break
            left -= pool[best]
            terms.append(best)
            pool = {g: ids for g, ids in pool.items() if len(ids & left) >= floor}
    # words that go with the label as strongly, though other terms cover their rows
    more = sorted((g for g, ids in holds.items() if len(ids) >= max(least, 0.1 * n_toxic) and not g.endswith("*") and lift[g] >= 50), key=lambda g: -lift[g])
    return {g: round(min(1.0, math.log10(lift[g]) / 3), 4) for g in sorted(set(terms) | set(more[:most_terms]))}


def fit_logistic(x: np.ndarray, y: np.ndarray, strength: float = 0.3, rounds: int = 50) -> np.ndarray:
    """Newton steps for logistic regression with a Gaussian prior around PRIOR."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), x.T @ (y - p) - strength * (w - PRIOR))
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


class ToxicityModel:
    def __init__(self, terms: dict[str, float], weights: np.ndarray):
        self.terms, self.weights = terms, weights


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = 800, max_clean: int = 2000, max_bytes: int = 64 << 20) -> ToxicityModel:
    """Learn lexicon and weights from labelled rows that aren't held out.

    The sample is bounded: the ``max_toxic`` and ``max_clean`` labelled identifiers with the smallest hashes, and of their whole texts, in
    the order of the hashes, as many as fit in ``max_bytes`` together. Several labels of one document count as toxic if one is. Null
    labels, identifiers and texts teach nothing. Without labels the lexicon is empty and every score is the prior's.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    order = F.xxhash64("_id")
    ids = marks.where("_y = 1").orderBy(order, "_id").limit(max_toxic).unionByName(marks.where("_y <> 1").orderBy(order, "_id").limit(max_clean))
    # at most max_toxic + max_clean identifiers are broadcast; the window sees their texts only
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text IS NOT NULL").join(F.broadcast(ids), "_id").dropDuplicates(["_id", "_text"])
    so_far = F.sum(F.octet_length("_text")).over(Window.orderBy(order, "_id", "_text"))
    sample = rows.withColumn("_bytes", so_far).where(F.col("_bytes") <= max_bytes).orderBy("_id", "_text").collect()
    texts, toxic = [r["_text"] for r in sample], [int(r["_y"]) for r in sample]
    terms = learn_lexicon(texts, toxic)
    if not terms:
        return ToxicityModel({}, PRIOR)
    matcher = Matcher(terms)
    return ToxicityModel(terms, fit_logistic(np.array([features(t, matcher) for t in texts]), np.array(toxic, float)))


def scorer(model: ToxicityModel):
    """A column function: text -> struct(score, evidence)."""

    @F.pandas_udf("score double, evidence double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher, w = Matcher(model.terms), model.weights
        for texts in batches:
            x = np.array([features(t, matcher) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pd.DataFrame({"score": 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))), "evidence": np.expm1(x[:, [0, 2, 3, 4]]).sum(axis=1)})

    return of


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Scores of all rows: ``doc_id, held_out, score, predicted, evidence``.

    Whole texts of any length are scored. Null and empty texts have no hits and get the intercept's score. Every row is
    scored alone: repeated rows get equal scores, identifiers of any type and size pass as they are, and null ones are not held out.
    A score that ties with the threshold is predicted as 1. An empty table gives no rows. Other columns are not read, so clashing names don't matter.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), scorer(model)(text_or_empty(text_col)).alias("s"))
    return rows.select("doc_id", "held_out", "s.score", (F.col("s.score") >= threshold).cast("int").alias("predicted"), "s.evidence")


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows scored under the threshold, with their own columns, which don't leave the JVM: names may clash and identifiers be of any type.

    Null, empty and very long texts, repeated rows and empty tables are treated as by ``score``.
    """
    bounded_batches(docs.sparkSession)
    return docs.where(scorer(model)(text_or_empty(text_col))["score"] < threshold)
