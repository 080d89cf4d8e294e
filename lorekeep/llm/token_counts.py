"""Token counts by compiled finite-state transducers, without encoding.

Two deterministic transducers read a text. The first cuts it into pre-tokens: its input is character
classes, its output marks where a pre-token begins. Texts are laid end to end, cut into equal chunks, and each
chunk becomes a map from state to state; a parallel prefix scan composes the maps, which gives every chunk
its first state, and all chunks are then run at once. The second reads the bytes of a pre-token; each
transition carries the number of tokens by which the count changes. Its states are compiled when first met.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.bpe import byte_characters
from lorekeep.llm.common import slices, whole_text

#: Characters that a chunk holds, and those that are laid end to end before a run.
CHUNK, LAID_OUT = 128, 1_000_000
#: Entries that each memory of a worker may hold before it is emptied.
#: At this bound a worker was measured at about 450 MB over documents of mostly new words.
REMEMBERED = 400_000
NEVER = float("inf")

# Character classes. The letters that contractions are made of are told apart from the others.
LETTER, ONE, R, V, L, E, NUMBER, SPACE, BLANK, QUOTE, OTHER, END = range(12)
# States: between tokens; in a run of letters, numbers or others; in white space of length one or more that
# ends in a space or another blank; after a quote that begins a token, and after that quote and r, v or l.
(FREE, LETTERS, NUMBERS, OTHERS, SPACE_1, BLANK_1, SPACE_N, BLANK_N, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L) = range(12)
#: Output bits: a token begins at this character; one begins at the character before.
HERE, BEFORE = 1, 2


def cutter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output for each state (row) and class (column) of the pre-tokenizer."""
    letters = (LETTER, ONE, R, V, L, E)
    run = dict.fromkeys(letters, LETTERS) | {NUMBER: NUMBERS, OTHER: OTHERS, QUOTE: OTHERS}
    begin = run | {QUOTE: QUOTED, SPACE: SPACE_1, BLANK: BLANK_1, END: FREE}
    many = {SPACE: SPACE_N, BLANK: BLANK_N}
    to, out = np.zeros((12, 12), np.uint8), np.full((12, 12), HERE, np.uint8)
    for state in range(12):
        for kind in range(12):
            to[state, kind] = begin[kind]

    def put(state: int, kinds: Iterable[int], target: dict[int, int] | int, output: int) -> None:
        for kind in kinds:
            to[state, kind] = target if isinstance(target, int) else target[kind]
            out[state, kind] = output

    put(LETTERS, letters, LETTERS, 0)
    put(NUMBERS, [NUMBER], NUMBERS, 0)
    put(OTHERS, [OTHER, QUOTE], OTHERS, 0)
    for state in (SPACE_1, BLANK_1, SPACE_N, BLANK_N):
        put(state, many, many, 0)
    put(SPACE_1, run, run, 0)
    put(SPACE_N, run, run, BEFORE)
    put(BLANK_N, run, begin, HERE | BEFORE)
    put(QUOTED, [ONE], FREE, 0)
    put(QUOTED, [OTHER, QUOTE], OTHERS, 0)
    for state, kind, last in ((QUOTED_R, R, E), (QUOTED_V, V, E), (QUOTED_L, L, L)):
        put(QUOTED, [kind], state, 0)
        put(state, range(12), begin, HERE | BEFORE)
        put(state, letters, LETTERS, BEFORE)
        put(state, [last], FREE, 0)
    return to, out


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point; the one past the last is the end of a text."""
    table = np.full(0x110001, OTHER, np.uint8)
    points = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for run in regex.finditer(pattern, points):
            table[run.start() : run.end()] = kind
    for kind, chars in ((SPACE, " "), (QUOTE, "'"), (ONE, "stmd"), (R, "r"), (V, "v"), (L, "l"), (E, "e")):
        table[[*map(ord, chars)]] = kind
    table[0x110000] = END
    return table


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps (a column each) that do `first`, then `then`."""
    return np.take_along_axis(then, first, axis=0)


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of the columns, in about log2(columns) parallel steps."""
    step = 1
    maps = maps.copy()
    while step < maps.shape[1]:
        maps[:, step:] = compose(maps[:, :-step], maps[:, step:])
        step *= 2
    return maps


def token_starts(kinds: np.ndarray) -> np.ndarray:
    """Whether a pre-token (or the end of a text) begins at each place; the first state is FREE."""
    to, out = (x.ravel() for x in cutter())
    chunks = -(-len(kinds) // CHUNK)
    padded = np.full(chunks * CHUNK, END, np.uint8)
    padded[: len(kinds)] = kinds
    steps = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T).astype(np.intp)
    maps = np.repeat(np.arange(12, dtype=np.uint8)[:, None], chunks, axis=1)
    for kind in steps:
        maps = to[maps * np.intp(12) + kind]
    state = np.concatenate([[FREE], scan(maps)[FREE, :-1]]).astype(np.intp)
    marks = np.empty((CHUNK, chunks), np.uint8)
    for at, kind in enumerate(steps):
        place = state * 12 + kind
        marks[at], state = out[place], to[place].astype(np.intp)
    marks = marks.T.ravel()[: len(kinds)]
    starts = (marks & HERE).astype(bool)
    starts[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return starts


class Counter:
    """Counts the tokens of words under byte-pair merges by a transducer whose states are compiled on demand.

    After any prefix of a word, the last token of the prefix's encoding is the only token that is a suffix of
    the prefix and stands unmerged after the encoding of what precedes it. What can still matter later is
    the longest suffix that begins some token, with the last token and the relative count at each place in it.
    """

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.tokens = tokens
        self.begins = {t[:i] for t in tokens for i in range(len(t) + 1)}
        self.ranks = {tokens[a] << 32 | tokens[b]: rank for rank, (a, b) in enumerate(merges)}
        #: For each token the parts that are its last (first) one while it is merged, up to the token itself,
        #: each with the rank of the merge that takes the part up.
        self.last_parts: dict[int, list[tuple[int, float]]] = {i: [(i, NEVER)] for i in tokens.values()}
        self.first_parts: dict[int, list[tuple[int, float]]] = {i: [(i, NEVER)] for i in tokens.values()}
        for rank, (a, b) in enumerate(merges):
            whole = tokens[a + b]
            for parts, side in ((self.last_parts, tokens[b]), (self.first_parts, tokens[a])):
                parts[whole] = [*parts[side][:-1], (side, rank), (whole, NEVER)]
        self._reset()

    def _reset(self) -> None:
        start = (b"", (None,), (0,))
        self.states, self.numbers, self.moves = [start], {start: 0}, {}

    def stand_apart(self, left: int, right: int) -> bool:
        """Whether the two tokens, written together, are encoded as the two.

        Merges happen in order of rank, so the parts on both sides of the seam grow in that order, and the
        tokens part ways only if no merge across the seam is due before one of its sides is taken up. Of equal
        merges the left one comes first.
        """
        lefts, rights, ranks, i, j = self.last_parts[left], self.first_parts[right], self.ranks, 0, 0
        while True:
            (a, a_ends), (b, b_ends) = lefts[i], rights[j]
            across = ranks.get(a << 32 | b, NEVER)
            if across < a_ends and across <= b_ends and across != NEVER:
                return False
            if a_ends <= b_ends:
                if a_ends == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition from a state on a byte: the next state, and by how much the count changes."""
        suffix, last, counts = self.states[state]
        suffix += bytes((byte,))
        keep = 0
        while suffix[keep:] not in self.begins:
            keep += 1
        # A token that is a suffix begins a token too, so it cannot be longer than what is kept.
        for at in range(keep, len(suffix)):
            token = self.tokens.get(suffix[at:])
            if token is not None and (last[at] is None or self.stand_apart(last[at], token)):
                break
        else:
            raise ValueError(f"no token ends in byte {byte}")
        change = counts[at] + 1
        new = (suffix[keep:], (*last[keep:], token), (*[c - change for c in counts[keep:]], 0))
        number = self.numbers.setdefault(new, len(self.states))
        if number == len(self.states):
            self.states.append(new)
        self.moves[state << 8 | byte] = number, change
        return number, change

    def count(self, word: bytes) -> int:
        if len(self.moves) > REMEMBERED:
            self._reset()
        moves, state, total = self.moves, 0, 0
        for byte in word:
            state, change = moves.get(state << 8 | byte) or self.compile(state, byte)
            total += change
        return total


class TextCounter:
    """Counts tokens as the tokenizers library does with a byte-level BPE file: its special strings count as one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = {c: b for b, c in enumerate(byte_characters())}

        def plain(token: str) -> bytes:
            return bytes(back[c] for c in token)

        special = {x["content"] for x in spec["added_tokens"]}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        merges = [(plain(a), plain(b)) for a, b in pairs]
        self.words = Counter({plain(t): i for t, i in spec["model"]["vocab"].items() if t not in special}, merges)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.known: dict[str, int] = {}

    def _counts(self, words: list[str]) -> np.ndarray:
        """The tokens of each word. What is remembered is bounded by REMEMBERED and one run's distinct words."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, count = self.known, self.words.count
        for word in {*words}.difference(known):
            known[word] = count(word.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _run(self, pieces: list[str], owners: list[int], totals: np.ndarray) -> None:
        """Adds the tokens of pieces, laid end to end with an end mark after each, to their owners."""
        laid = "\0".join([*pieces, ""])
        points = np.frombuffer(laid.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        points[ends] = 0x110000
        starts = token_starts(classes()[points])
        starts[ends] = True
        places = np.flatnonzero(starts)
        cuts = [*places.tolist(), len(laid)]
        counts = self._counts([laid[a:b] for a, b in zip(cuts, cuts[1:])])
        at_end = np.searchsorted(places, ends)
        counts[at_end] = 0
        sums = np.cumsum(counts)[at_end]
        np.add.at(totals, owners, np.diff(sums, prepend=0))

    def count_batch(self, texts: Iterable[str], n: int) -> np.ndarray:
        """The number of tokens of each of n texts, which are taken one by one."""
        totals, pieces, owners, size = np.zeros(n, np.int64), [], [], 0
        for i, text in enumerate(texts):
            parts = self.special.split(text)
            totals[i] += len(parts) - 1
            pieces += parts
            owners += [i] * len(parts)
            size += len(text)
            if size >= LAID_OUT:
                self._run(pieces, owners, totals)
                pieces, owners, size = [], [], 0
        if pieces:
            self._run(pieces, owners, totals)
        return totals


@functools.lru_cache(maxsize=4)
def text_counter(path: str) -> TextCounter:
    """One counter for each worker process and tokenizer file."""
    return TextCounter(path)


def with_token_counts(docs: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """docs with the long column `name` (replaced where docs has one): the tokens of each whole text.

    Null and empty texts have none. Rows are independent, so repeated rows, ties, nulls and other columns
    pass through; an empty table stays empty. `path` must exist on all executors.
    """

    @F.arrow_udf("long")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = text_counter(path)
        for part in slices(batches):
            yield pa.array(own.count_batch((x.as_py() for x in part), len(part)))

    return docs.withColumn(name, counts(whole_text(text)))
