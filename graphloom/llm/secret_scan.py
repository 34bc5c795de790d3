"""Secret scans: fixed patterns, and guess-cost dynamic programming on credential-context values.

The cost of a value is the least log10 number of guesses over its segmentations
into known words, dates, repeats, keyboard walks, character sequences and brute-force
characters. A value that stands in a credential context (``pwd: ...``, ``bearer ...``,
``db_pwd=...``, or a word of the fixed patterns), is not covered by a fixed span as a whole and costs at least ``least`` is reported as kind ``guess``; the fixed patterns are
always reported.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, text_or_empty

#: The patterns of each kind (group to measure, least length), in report order.
KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),  # a maximal run either has the length or fails as a whole
}
CONTEXT = re.compile(r"""(password|passwd|secret|token|api_?key|(?<![A-Za-z0-9])(?:pwd|pass|passphrase|passcode|pin|auth|credentials?|bearer|private_?key|access_?key|client_?key))\b["']?\x20*(?:[:=]|\bis\b|(?<=bearer)\x20)\x20*["']?([^\s"']{6,})""", re.I | re.A)
ORDER = {"assign": 0, "access": 1, "hex": 2, "guess": 3}

#: Common password words, most frequent first.
WORDS = "password qwerty dragon monkey letmein master shadow admin welcome login hello secret princess sunshine football baseball superman batman trustno love god sex money summer winter spring autumn hunter killer test guest root user pass access flower ninja mustang michael jordan charlie thomas jessica computer internet database server changeme default example sample demo temp token key".split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
#: Ordinary words that prose puts after a context word, ranked after the password words.
PROSE = """
the and for with that this from you your not are was were will would should could can may must have has had been being also only when where which while what who how why then than there here they them
their our his her its all any each every some none more most less least very just into onto over under after before about above below between through during within without against because since until
required require requires requested request invalid valid incorrect correct missing expired expires changed change changes reset resets forgotten forgot stored store saved save encrypted hashed plain
provided provide following empty blank optional necessary mandatory unknown wrong right weak strong unique secure security safe protected protection private public policy policies manager management
generator field fields value values string number numbers letter letters character characters length code codes word words phrase name names username account accounts email address login signin signup
session sessions cookie cookies header headers server client service services system systems application applications module modules method methods function functions type types file files folder path
config configuration setting settings option options parameter parameters variable variables document documents documentation page pages website network provider providers authentication authenticated
authorization authorized authority authorities identity certificate certificates signature verify verified verification between people another thing things place world country city state government
company business market history story stories recipe recipes garden gardens agent agents society sauce weapon meeting ingredient life love friend friends family mother father brother sister child
children woman women school student students teacher book books music movie movies picture water house street road number morning evening night today tomorrow yesterday always never often sometimes
already again still almost enough around across along together something anything nothing everything someone everyone holder holders issue issued issues economy payment payments ring cash money gift
appreciation gratitude bearer bond bonds bear card cards point points board wheel drop down away back off out judgment sentence law laws legislation time test tests exam exams season rusher one two
three four five six seven eight nine ten first second third last next new old good bad best better great small large long short high low open close closed start stop end use used uses using user users
make made makes take taken get gets give given find found keep kept know known need needed needs see seen set sets show shown tell told think want work works please thank thanks hello contact support
help information details report reports data example placeholder redacted hidden null undefined true false yours itself myself
""".split()
for _word in PROSE:
    RANK.setdefault(_word, len(RANK) + 1)
#: Keyboard rows whose neighbours make a walk.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("0134578@$", "oieastbas")


def _adjacent() -> set[tuple[str, str]]:
    place = {c: (x + 0.5 * y, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    return {(a, b) for a, (x, y) in place.items() for b, (u, v) in place.items() if a != b and abs(x - u) <= 1 and abs(y - v) <= 1}


NEAR = _adjacent()
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 1000


#: log10 guesses of choosing a kind of span, of a turn on the keyboard and of a step in a sequence.
CHOICE, TURN, STEP = 0.3, 0.45, 0.05


def word_cost(value: str, low: str, plain: str, k: int, j: int) -> float:
    """Guesses of value[k:j] as a known word, with its capitals and look-alikes; infinite if it is none."""
    rank = RANK.get(plain[k:j])
    if not rank:
        return math.inf
    part = value[k:j]
    return math.log10(rank + 1) + (0.6 if part != part.lower() else 0) + (0.6 if low[k:j] != plain[k:j] else 0) + CHOICE


def _by_ends(words: dict[str, int]) -> dict:
    """Words of three letters and more as a trie read from their ends; a word's rank stands under the empty key."""
    root: dict = {}
    for word, rank in words.items():
        node = root
        for c in reversed(word if len(word) > 2 else ""):
            node = node.setdefault(c, {})
        if len(word) > 2:
            node[""] = rank
    return root


ENDS = _by_ends(RANK)
LOGS = {size: math.log10(size) for size in (10, 26, 33, 1000)}
TURNS = (("repeat", 0.0), ("walk", TURN), ("sequence", STEP))


class Starts:
    """The starts of a run that may still be the cheapest one, for one kind of run.

    Up to a common part, a run from k to j costs ``g + log10(j - k)``, where g is the cost before k and of its first character, less the turns saved. A later start is
    the cheaper one only while the run is short: once an earlier start costs no more it never costs more again, so the later one goes; and an earlier start whose g is no less than
    a later one's never catches up. The starts that are left have rising g and falling cost, so the last is the cheapest; in practice they are one or two, however long the run.
    """

    def __init__(self, turn: float) -> None:
        self.turn, self.starts = turn, []

    def cheapest(self, j: int, k: int, g: float) -> float:
        """Add the start k, then the least cost of a run that ends at j."""
        starts = self.starts
        while starts and starts[-1][1] >= g:
            starts.pop()
        starts.append((k, g))
        if len(starts) > 1:
            kept, least = [], math.inf
            for start in starts:
                cost = start[1] + math.log10(j - start[0])
                if cost < least:
                    kept.append(start)
                    least = cost
            self.starts = kept
        k, g = self.starts[-1]
        return g + math.log10(j - k) + self.turn * (j - 1) + CHOICE


def guess_cost(value: str) -> float:
    """Least log10 guesses over all segmentations; 0 for an empty value.

    best[j] is the least cost of the first j characters. A word or date ends within a fixed reach; a repeat, walk or sequence may start anywhere in
    its run, of which only the starts that can still win are kept. The time is linear in the value's length.
    """
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    single = [LOGS[_alphabet(c)] for c in value]
    best = [0.0]
    runs = [0, 0, 0]
    open_runs = [Starts(turn) for _, turn in TURNS]
    for j in range(1, n + 1):
        total = best[j - 1] + single[j - 1]
        node, k = ENDS.get(plain[j - 1]), j - 1
        while node and k:
            k -= 1
            node = node.get(plain[k])
            if node and "" in node:
                total = min(total, best[k] + word_cost(value, low, plain, k, j))
        if value[j - 1].isdigit():
            for k in range(max(0, j - 10), j - 3):
                if value[k].isdigit() and DATE.fullmatch(value, k, j):
                    total = min(total, best[k] + (2.1 if j - k == 4 else 4.6))
        if j > 1:
            a, b = low[j - 2], low[j - 1]
            goes_on = (a == b, (a, b) in NEAR, abs(ord(a) - ord(b)) == 1)
            for i in range(3):
                if not goes_on[i]:
                    if runs[i] > 1:
                        open_runs[i].starts = []
                    runs[i] = 0
                    continue
                runs[i] += 1
                if runs[i] > 1:  # three characters or more
                    k = j - 3
                    total = min(total, open_runs[i].cheapest(j, k, best[k] + single[k] - TURNS[i][1] * k))
        best.append(total)
    return best[n]


def scan(text: str, least: float = 8.0) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span by start, then kind; code points, end exclusive."""
    found = [(kind, m.start(), m.end()) for kind, (pattern, group, size) in KINDS.items() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= size]
    base = sorted((a, b) for _, a, b in found)
    reach = list(accumulate((b for _, b in base), max))  # the furthest end of the spans that start no later
    at, starts = 0, [a for a, _ in base]
    while m := CONTEXT.search(text, at):
        at = m.end(1)  # a value may itself be the context of the next one
        value = m.group(2).rstrip(".,;:!?)]}>")
        a, b = m.start(2), m.start(2) + len(value)
        before = bisect_right(starts, a)
        covered = before and reach[before - 1] >= b
        if len(value) >= 6 and not covered and guess_cost(value) >= least:
            found.append(("guess", a, b))
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 8.0) -> DataFrame:
    """Spans of every row: ``doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans``.

    Null and empty texts have no spans (the digest of the empty string). Rows are scanned
    alone and whole, however long; repeated rows, null identifiers and identifiers of any type and size are returned as they come. Of spans with one start
    the kind's order decides. An empty table gives no rows. Other columns are not read, so clashing names don't matter.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        spans = [scan(t, least) for t in texts]
        found = {f"n_{kind}": [sum(s[0] == kind for s in x) for x in spans] for kind in ORDER}
        found["base_sha256"] = [hashlib.sha256(joined([s for s in x if s[0] != "guess"]).encode()).hexdigest() for x in spans]
        return pd.DataFrame(found | {"spans": [joined(x) for x in spans]})

    return docs.select(F.col(id_col).alias("doc_id"), scanned(text_or_empty(text_col)).alias("s")).select("doc_id", "s.*")
