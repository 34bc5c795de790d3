"""Token counts by a tokenizer compiled to finite-state transducers.

A byte-level BPE tokenizer becomes two deterministic machines.

``Cutter`` reads classes of code points and says where words start. It has 13 states and says at most one
code point late, so it needs no look-ahead. The batch is cut into equal chunks, which all run at once: each gives the map from
the state at its start to the state at its end. The maps compose through a parallel prefix scan, which
tells every chunk the state that it starts in. The compiler finds after how many symbols all states meet (the machine's
reset length), so that a chunk follows all start states only that far.

``Counter`` reads the bytes of a word. Its transitions carry the change of the word's token count, so a word's
count is the sum of what its path carries, and no token is ever built. The state after a prefix keeps, for
every suffix that may still grow into a token, the token before it and the count there; of
the tokens that end at a byte, exactly one may follow the token before it (a pair of tokens may stand side by side
if no merge crosses their border before one of the two is whole). States are compiled when first met, kept for
the life of the worker, and forgotten when there are more than ``most_states``.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, free_names, text_or_empty

#: Classes of code points. Letters that can follow an apostrophe in a contraction have classes of their own.
LETTER, NUMBER, BLANK, SPACE, APOSTROPHE, OTHER, SPECIAL = range(7)
LAST, R, V, L, E = range(7, 12)  # LAST: s, t, m, d end a contraction at once; 're, 've and 'll take two letters
N_CLASSES = 12
LETTERS = {LETTER, LAST, R, V, L, E}

#: States: what has been read since the last start of a word.
BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_BLANK, ONE_SPACE, MORE_BLANK, MORE_SPACE, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, CONTRACTED = range(13)
N_STATES = 13
#: What a transition says: a word starts here, a word started one code point before.
HERE, BEFORE = 1, 2


def _cut(state: int, kind: int) -> tuple[int, int]:
    """One transition of the cutter: (next state, what it says)."""
    if kind in (BLANK, SPACE):
        if state in (ONE_BLANK, ONE_SPACE, MORE_BLANK, MORE_SPACE):
            return (MORE_BLANK if kind == BLANK else MORE_SPACE), 0
        late = BEFORE if state in (QUOTE_R, QUOTE_V, QUOTE_L) else 0
        return (ONE_BLANK if kind == BLANK else ONE_SPACE), HERE | late
    # the last white space of a run is a word of its own, or belongs to the word after it if it is a blank
    late = BEFORE if state in (MORE_BLANK, MORE_SPACE) else 0
    joined = state in (ONE_BLANK, MORE_BLANK)
    if kind in LETTERS:
        if state == QUOTE and kind == LAST:
            return CONTRACTED, 0
        if state == QUOTE and kind in (R, V, L):
            return {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[kind], 0
        if (state in (QUOTE_R, QUOTE_V) and kind == E) or (state == QUOTE_L and kind == L):
            return CONTRACTED, 0
        if state in (QUOTE_R, QUOTE_V, QUOTE_L):
            return IN_LETTERS, BEFORE
        return IN_LETTERS, late | (0 if joined or state == IN_LETTERS else HERE)
    late |= BEFORE if state in (QUOTE_R, QUOTE_V, QUOTE_L) else 0
    if kind == NUMBER:
        return IN_NUMBERS, late | (0 if joined or state == IN_NUMBERS else HERE)
    if joined or state in (IN_OTHERS, QUOTE):
        return IN_OTHERS, late
    return (QUOTE if kind == APOSTROPHE else IN_OTHERS), late | HERE


class Cutter:
    """The transducer over classes; a symbol with ``N_CLASSES`` added begins a text, whatever the state was."""

    def __init__(self) -> None:
        self.next = np.zeros((N_STATES, 2 * N_CLASSES), np.uint8)
        self.says = np.zeros((N_STATES, 2 * N_CLASSES), np.uint8)
        for state in range(N_STATES):
            for kind in range(N_CLASSES):
                if kind != SPECIAL:  # a special token is set apart by the symbols that begin texts
                    self.next[state, kind], self.says[state, kind] = _cut(state, kind)
                    first = _cut(BEGIN, kind)
                else:
                    self.next[state, kind], first = BEGIN, (BEGIN, HERE)
                self.next[state, kind + N_CLASSES] = first[0]
                # a contraction that the end of the text breaks off was none
                self.says[state, kind + N_CLASSES] = first[1] | (BEFORE if state in (QUOTE_R, QUOTE_V, QUOTE_L) else 0)
        self.reset = self._reset_length()

    def _reset_length(self) -> int:
        """The least number of symbols after which all start states have met, whatever the symbols are."""
        level, length = {frozenset(range(N_STATES))}, 0
        while any(len(s) > 1 for s in level):
            level, length = {frozenset(int(self.next[q, a]) for q in s) for s in level for a in range(2 * N_CLASSES)}, length + 1
            if length > 64:
                raise ValueError("the machine has no reset length")
        return length

    def entries(self, symbols: np.ndarray) -> np.ndarray:
        """The state in which each chunk starts, of symbols [step, chunk]; the first chunk starts in BEGIN."""
        reach = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], symbols.shape[1], 1)
        for row in symbols[: self.reset]:
            reach = self.next[reach, row]
        state = reach[0]
        for row in symbols[self.reset :]:  # all start states have met
            state = self.next[state, row]
        maps = np.broadcast_to(state, reach.shape).copy() if len(symbols) > self.reset else reach
        return compose(maps)

    def starts(self, symbols: np.ndarray, width: int = 256) -> np.ndarray:
        """Whether a word starts at each symbol of one array that begins a text."""
        n = len(symbols)
        chunks = -(-n // width)
        padded = np.full(chunks * width, N_CLASSES, np.uint8)
        padded[:n] = symbols
        steps = np.ascontiguousarray(padded.reshape(chunks, width).T)
        state = self.entries(steps)
        said = np.empty_like(steps)
        for i, row in enumerate(steps):
            said[i] = self.says[state, row]
            state = self.next[state, row]
        said = said.T.reshape(-1)
        found = (said & HERE).astype(bool)
        found[:-1] |= (said[1:] & BEFORE).astype(bool)
        found = found[:n]
        if n == len(said) and n and state[-1] in (QUOTE_R, QUOTE_V, QUOTE_L):
            found[n - 1] = True
        return found


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix scan of chunk maps [state, chunk], shifted: the state in which each chunk starts."""
    maps, n, span = maps.copy(), maps.shape[1], 1
    while span < n:  # map of chunks a..b after that of chunks before a
        maps[:, span:] = np.take_along_axis(maps[:, span:], maps[:, :-span].astype(np.intp), 0)
        span *= 2
    return np.concatenate([np.full(1, BEGIN, np.uint8), maps[BEGIN, :-1]])


class Counter:
    """The transducer over the bytes of a word, compiled as far as words have led.

    What a token forbids to come after it is a map from parts to ranks: a token whose left edge has the part, made before that merge
    would have its turn, cannot follow. Tokens that forbid the same count as one, and at a node of the trie only parts that agree with its bytes matter, so
    few states are told apart.
    """

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], most_states: int = 1 << 17) -> None:
        self.most, self.never = most_states, len(merges) + 1
        self.bytes = {number: piece for piece, number in vocab.items()}
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.crossing: dict[int, list[tuple[int, int]]] = {}
        for rank, (a, b) in enumerate(merges):
            self.crossing.setdefault(vocab[a], []).append((rank, vocab[b]))
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b], rank))
        missing = [b for b in range(256) if bytes([b]) not in vocab]
        if missing:
            raise ValueError(f"{len(missing)} bytes have no token")
        self.child: dict[int, int] = {}
        self.token: dict[int, int] = {}
        self.depth = [0]
        for piece, number in vocab.items():
            if len(piece) > 1 and number not in self.parts:
                continue  # no merge makes it
            at = 0
            for b in piece:
                key = at << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.depth)
                    self.depth.append(self.depth[at] + 1)
                at = self.child[key]
            self.token[at] = number
        self.inner = {key >> 8 for key in self.child}
        self._forget()

    def _forget(self) -> None:
        self.forbids: list[dict[int, int]] = [{}]
        self.known = {frozenset(): 0}
        self.after_token: dict[int, int] = {}
        self.narrowed: dict[int, int] = {}
        self.allowed: dict[int, bool] = {}
        self._forget_states()

    def _forget_states(self) -> None:
        self.states: list[tuple] = [((0, 0, 0),)]
        self.number = {self.states[0]: 0}
        #: at state << 8 | byte: next state << 8 | change + 128, or -1
        self.table = np.full(1024 << 8, -1, np.int32)

    def _numbered(self, forbidden: dict[int, int]) -> int:
        key = frozenset(forbidden.items())
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.forbids)
            self.forbids.append(forbidden)
        return found

    def _after(self, token: int) -> int:
        """What may not follow a token: for each part on its right edge, merges that come before the part is taken away."""
        found = self.after_token.get(token)
        if found is None:
            forbidden: dict[int, int] = {}
            part, ends = token, self.never
            while True:
                for rank, right in self.crossing.get(part, ()):
                    if rank >= ends:
                        break
                    forbidden[right] = min(rank, forbidden.get(right, rank))
                if part not in self.parts:
                    break
                _, part, ends = self.parts[part]
            found = self.after_token[token] = self._numbered(forbidden)
        return found

    def _narrow(self, forbidden: int, node: int, byte: int) -> int:
        """The same at a child of the trie: parts that agree with its last byte, or end before it."""
        if not forbidden:
            return 0
        key = forbidden << 32 | node
        found = self.narrowed.get(key)
        if found is None:
            at = self.depth[node] - 1
            found = self.narrowed[key] = self._numbered({p: r for p, r in self.forbids[forbidden].items() if len(self.bytes[p]) <= at or self.bytes[p][at] == byte})
        return found

    def _may_follow(self, forbidden: int, token: int) -> bool:
        if not forbidden:
            return True
        key = forbidden << 32 | token
        found = self.allowed.get(key)
        if found is None:
            ranks, part, ends, found = self.forbids[forbidden], token, self.never, True
            while found:
                # of equal merges the left one comes first, so the crossing one comes before the one that takes this part away
                found = ranks.get(part, self.never + 1) > ends
                if part not in self.parts:
                    break
                part, _, ends = self.parts[part]
            self.allowed[key] = found
        return found

    def _compile(self, state: int, byte: int) -> None:
        grown, last, gained = [], None, 0
        for node, forbidden, count in self.states[state]:
            at = self.child.get(node << 8 | byte)
            if at is None:
                continue
            forbidden = self._narrow(forbidden, at, byte)
            if at in self.inner:
                grown.append((at, forbidden, count))
            if last is None and (token := self.token.get(at)) is not None and self._may_follow(forbidden, token):
                last, gained = token, count + 1
        key = (*[(at, forbidden, count - gained) for at, forbidden, count in grown], (0, self._after(last), 0))
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.states)
            self.states.append(key)
            if found << 8 >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        self.table[state << 8 | byte] = found << 8 | gained + 128

    def count(self, data: np.ndarray, at: np.ndarray, length: np.ndarray, long: int = 256, block: int = 1 << 16) -> np.ndarray:
        """Tokens of the words that start at ``at`` in the bytes ``data``; words longer than ``long`` one by one."""
        out = np.zeros(len(at), np.int64)
        order = np.argsort(-length, kind="stable")
        tall = int(np.searchsorted(-length[order], -long, "left"))
        for i in order[:tall]:
            out[i] = self._count_one(data[at[i] : at[i] + length[i]].tobytes())
        for a in range(tall, len(order), block):
            if len(self.states) > self.most or len(self.narrowed) > 8 * self.most:
                self._forget()
            lanes = order[a : a + block]
            where, size = at[lanes], length[lanes]
            state, counts = np.zeros(len(lanes), np.int32), np.zeros(len(lanes), np.int32)
            # lanes are sorted by falling length, so those that still run come first
            running = np.searchsorted(-size, -np.arange(int(size[0])), "left") if len(size) else ()
            for step, n in enumerate(running):
                at_step = state[:n] << 8 | data[where[:n] + step]
                found = self.table[at_step]
                if (found < 0).any():
                    for key in np.unique(at_step[found < 0]).tolist():
                        self._compile(key >> 8, key & 255)
                    found = self.table[at_step]
                counts[:n] += (found & 255) - 128
                state[:n] = found >> 8
            out[lanes] = counts
        return out

    def _count_one(self, word: bytes) -> int:
        state = total = 0
        for i, byte in enumerate(word):
            if not i & 0xFFFF and len(self.states) > self.most:
                kept = self.states[state]
                self._forget_states()
                state = self.number.setdefault(kept, len(self.states))
                if state == len(self.states):
                    self.states.append(kept)
            found = int(self.table[state << 8 | byte])
            if found < 0:
                self._compile(state, byte)
                found = int(self.table[state << 8 | byte])
            total += (found & 255) - 128
            state = found >> 8
        return total


class Compiled:
    """What workers need: the class of every code point, the special strings, the vocabulary."""

    def __init__(self, definition: str, kinds: bytes, most_states: int) -> None:
        model = json.loads(definition)
        table = {c: b for b, c in _byte_alphabet().items()}
        as_bytes = lambda s: bytes(table[c] for c in s)
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.kinds = np.frombuffer(kinds, np.uint8)
        self.cutter = Cutter()
        self.counter = Counter({as_bytes(t): i for t, i in model["model"]["vocab"].items()}, [(as_bytes(a), as_bytes(b)) for a, b in pairs], most_states)
        special = sorted((t["content"].encode() for t in model["added_tokens"]), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None

    def special_spans(self, data: np.ndarray, edges: np.ndarray) -> list[tuple[int, int]]:
        """Special strings inside texts, from the left, the longest at a place."""
        if self.special is None:
            return []
        whole, found, at = data.tobytes(), [], 0
        while hit := self.special.search(whole, at):
            end = int(edges[np.searchsorted(edges, hit.start(), "right")])  # of the text that holds its first byte
            if hit.end() > end:
                hit = self.special.search(whole, hit.start(), end)
                if hit is None:
                    at = end
                    continue
            found.append(hit.span())
            at = hit.end()
        return found

    def count(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Tokens of the texts whose bytes lie one after the other in ``data``, between ``edges``."""
        texts = len(edges) - 1
        if not len(data):
            return np.zeros(texts, np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        symbols = self.kinds[_code_points(data, lead)]
        of_byte = lambda b: np.searchsorted(lead, b)
        begin = edges[:-1][edges[:-1] < edges[1:]]
        symbols[of_byte(begin)] |= 0x80
        spans = self.special_spans(data, edges)
        for a, b in spans:
            symbols[of_byte(a) : of_byte(b)] = SPECIAL
            symbols[of_byte(a)] |= 0x80
            if b < len(data):
                symbols[of_byte(b)] |= 0x80
        symbols = np.where(symbols & 0x80, (symbols & 0x7F) + N_CLASSES, symbols).astype(np.uint8)
        at = lead[self.cutter.starts(symbols)]
        length = np.diff(at, append=len(data))
        counts = np.ones(len(at), np.int64)
        plain = np.ones(len(at), bool)
        plain[np.searchsorted(at, [a for a, _ in spans])] = False
        counts[plain] = self.counter.count(data, at[plain], length[plain])
        return np.bincount(np.searchsorted(edges, at, "right") - 1, counts, texts).astype(np.int64)


def _code_points(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    first = data[lead].astype(np.int32)
    out = first.copy()
    for least, size, mask in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
        some = np.flatnonzero((first >= least) & (first < (0xE0, 0xF0, 0xF8)[size - 2]))
        if len(some):
            value = first[some] & mask
            for i in range(1, size):
                value = value << 6 | (data[np.minimum(lead[some] + i, len(data) - 1)] & 0x3F)
            out[some] = value
    return np.minimum(out, 0x10FFFF)


def _byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (32, 0xAD)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


def code_point_kinds(definition: str) -> bytes:
    """The class of every code point, as the installed library has it.

    Classes are guessed from Unicode categories; the library then cuts each class written as one run, and where a run falls apart
    (its tables are of another Unicode version) it is asked about the code points of the piece.
    """
    from tokenizers import Tokenizer

    cut = Tokenizer.from_str(definition).pre_tokenizer.pre_tokenize_str
    kinds = np.full(0x110000, OTHER, np.uint8)
    category = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        kinds[c] = category.get(unicodedata.category(chr(c))[0], OTHER)
    white = [9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    kinds[white], kinds[32] = SPACE, BLANK
    asked = {LETTER: "a", NUMBER: "1", OTHER: "!"}

    def ask(c: str) -> int:
        return next((k for k, beside in asked.items() if len(cut(beside + c)) == 1), SPACE)

    for kind in (LETTER, NUMBER, OTHER):
        run = "".join(map(chr, np.flatnonzero(kinds == kind).tolist())).encode("utf-8", "ignore").decode()
        # an apostrophe among the others doesn't begin a word there
        pieces = [run[a:b] for _, (a, b) in cut(run)]
        for piece in pieces if len(pieces) > 1 else ():
            if (found := ask(piece[0])) != kind:
                for c in piece:
                    kinds[ord(c)] = ask(c)
    kinds[ord("'")] = APOSTROPHE
    for letters, kind in (("stmd", LAST), ("r", R), ("v", V), ("l", L), ("e", E)):
        kinds[[ord(c) for c in letters]] = kind
    return kinds.tobytes()


def _supported(definition: str) -> None:
    """Raise unless the tokenizer is of the kind that this compiler knows."""
    d = json.loads(definition)
    cutting, model = d.get("pre_tokenizer") or {}, d["model"]
    plain = cutting.get("type") == "ByteLevel" and cutting.get("use_regex", True) and not cutting.get("add_prefix_space", True)
    bpe = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    added = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in d["added_tokens"])
    if not (plain and bpe and added and d.get("normalizer") is None and d.get("truncation") is None):
        raise ValueError("only byte-level BPE with the standard word pattern and without a normalizer can be compiled")


_COMPILED: dict[tuple[int, int], Compiled] = {}


def _pieces(data: np.ndarray, edges: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes in all."""
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + most, "right")) - 1)
        yield a, b
        a = b


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", most_states: int = 1 << 17) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row, in one pass without a shuffle.

    tokenizer: path of a tokenizer definition of the ``tokenizers`` library (byte-level BPE), read by the driver and broadcast (at most 64 MB). Counts are those of the library
    without added begin, end or special tokens, truncation or padding; a special string inside a text is one token. Null texts count as empty, empty texts have no
    tokens; long texts are read whole; repeated rows and rows with null identifiers are counted like others; an empty table gives no rows. Other columns
    are not read. Memory of a worker: a batch of at most 8 MB (a longer text is a batch of its own), some 20 times its bytes while it is cut, and
    ``most_states`` states of 1 KB.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    with open(tokenizer, encoding="utf-8") as file:
        definition = file.read()
    _supported(definition)
    spark = docs.sparkSession
    kinds = code_point_kinds(definition)
    if len(definition) + len(kinds) > 64 << 20:
        raise ValueError("the tokenizer is larger than 64 MB")
    shipped = spark.sparkContext.broadcast((definition, kinds))
    bounded_batches(spark)
    name = free_names(docs, 2)
    rows = docs.select(F.col(id_col).alias(name[0]), text_or_empty(text_col).alias(name[1]))
    ids = rows.schema[name[0]].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (hash(shipped.value[0]), most_states)
        if key not in _COMPILED:
            _COMPILED.clear()
            _COMPILED[key] = Compiled(*shipped.value, most_states)
        machine = _COMPILED[key]
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
            tokens = np.zeros(len(texts), np.int64)
            for a, b in _pieces(data, offsets, 2 << 20):
                tokens[a:b] = machine.count(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"`{id_col}` {ids}, n_bytes long, n_tokens long, over_limit boolean")
