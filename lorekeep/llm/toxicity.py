"""Toxicity scores from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams, hashed to rows of an embedding table. A text is the sum of two averages: of
all its words, and of the words of its most toxic window (by default one word), so that a long text is not diluted. A softmax layer
of two classes reads the sum. Table and layer are trained together, so a misspelling that was never seen shares
the vectors of the n-grams it kept.

Everything after the layer is linear in the embeddings, so a trained model reduces to one number for each
n-gram row, and executors score words by the mean of their rows, texts and windows by the mean of their words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import give_back, own_name, slices, whole_text

WORD = regex.compile(r"[\p{L}\p{N}](?:[\p{L}\p{N}'@$!*_-]*[\p{L}\p{N}])?")
#: Words that a worker remembers; the memory is emptied when it is full.
REMEMBERED = 200_000
#: Words whose n-grams training handles at a time, and words of texts.
BLOCK, PART = 20_000, 200_000
#: Multipliers of the n-gram hash.
FACTOR, SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """What training takes and how it goes.

    window: words of a window. sample: the most labelled rows that training takes, those of smallest hash;
    characters: it takes no further row once the rows before hold so many.
    """

    rows: int = 1 << 17
    size: int = 16
    shortest_gram: int = 3
    longest_gram: int = 6
    window: int = 1
    sample: int = 5_000
    characters: int = 20_000_000
    rounds: int = 80
    rate: float = 0.1
    decay: float = 5e-2
    seed: int = 5


def gram_rows(words: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The embedding rows of the words' n-grams, between boundary marks, and the word of each; every word has some.

    All words are hashed at once: a polynomial of the code points of each stretch of n.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    laid = "".join([f"<{w}>" for w in words]).lower() if words else ""
    if len(laid) != lengths.sum():  # a few letters change their number in lower case
        lowered = [f"<{w.lower()}>" for w in words]
        laid, lengths = "".join(lowered), np.fromiter(map(len, lowered), np.int64, len(words))
    points = np.frombuffer(laid.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))
    rows, owners, value = [], [], np.zeros(len(points), np.uint64)
    for n in range(1, min(settings.longest_gram, len(points)) + 1):
        value[: len(points) - n + 1] = value[: len(points) - n + 1] * FACTOR + points[n - 1 :]
        if n >= settings.shortest_gram:
            fits = left >= n
            mixed = (value[fits] + np.uint64(n)) * SPREAD
            rows.append((mixed >> np.uint64(40)).astype(np.int32) % settings.rows)
            owners.append(owner[fits])
    return np.concatenate(rows), np.concatenate(owners)


def _gram_blocks(words: list[str], settings: Settings) -> tuple[list[tuple], np.ndarray]:
    """Blocks of words (first word, places of their rows word by word, rows per word), and the rows used.

    Training goes through the blocks, so that its temporary arrays are as large as one block's.
    """
    made, used = [], np.zeros(settings.rows, bool)
    for begin in range(0, len(words), BLOCK):
        found, of = gram_rows(words[begin : begin + BLOCK], settings)
        used[found] = True
        made.append((begin, found[np.argsort(of, kind="stable")], np.bincount(of)))
    place = np.cumsum(used, dtype=np.int32) - 1
    for i, (begin, found, n) in enumerate(made):
        made[i] = begin, place[found], n
    return made, np.flatnonzero(used)


class Vocabulary(dict):
    """Numbers words as they are met."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number

    def add(self, text: str) -> np.ndarray:
        return np.array([*map(self.__getitem__, WORD.findall(text))], np.int32)


def blocks_of(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words (none empty), their blocks of half a window: first word, number of words; and whether it is a text's last.

    A window is a block and the next one of its text, so windows overlap by half; a text of one block is one window. A window of one
    word is a block by itself.
    """
    step = max(1, window // 2)
    counts = -(-words // step)
    ends = np.cumsum(counts)
    place = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
    first = np.repeat(np.cumsum(words) - words, counts) + place * step
    last = np.zeros(len(first), bool)
    last[ends - 1] = True
    length = np.full(len(first), step)
    length[last] = words - (counts - 1) * step
    return first, length, last


def windows(values: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Sums over windows of sums over blocks. A last block has no window of its own unless its text has no other: -inf there."""
    if window == 1:
        return values.copy()
    both = values.copy()
    both[:-1] += np.where(last[:-1], 0.0, values[1:])
    both[1:][last[1:] & ~last[:-1]] = -np.inf
    return both


def _parts(docs: list[np.ndarray], y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The words of some texts laid end to end, the sizes of the texts and their labels, about PART words at a time."""
    sizes = np.array([len(d) for d in docs])
    number = np.cumsum(sizes) // PART
    for own in np.split(np.arange(len(docs)), np.flatnonzero(np.diff(number)) + 1):
        yield np.concatenate([docs[i] for i in own]), sizes[own], y[own]


def _pulls(margin: np.ndarray, sizes: np.ndarray, y: np.ndarray, offset: float, window: int, even: bool) -> tuple[np.ndarray, np.ndarray]:
    """By how much the loss of each text moves with the margin of each of its words, and with the offset."""
    first, length, last = blocks_of(sizes, window)
    counts = np.diff(np.flatnonzero(last), prepend=-1)  # blocks of each text
    begins = np.cumsum(counts) - counts
    span = windows(length.astype(float), last, window)
    real = span > 0
    span[~real] = 1.0
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), counts)
    block_margin = np.add.reduceat(margin, first)
    window_margin = windows(block_margin, last, window) / span
    if even:  # each text's windows share its decision
        score = np.add.reduceat(np.where(real, window_margin, 0.0), begins) / np.bincount(owner, real)
    else:
        score = np.maximum.reduceat(window_margin, begins)
    logit = score + np.add.reduceat(block_margin, begins) / sizes + offset
    error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y  # of the class-1 logit; of class 0 its negative
    deciding = real if even else window_margin == score[owner]
    pull = np.where(deciding, (error / np.bincount(owner, deciding))[owner] / span, 0.0)
    block_pull = pull + (error / sizes)[owner]
    if window > 1:
        second = np.flatnonzero(real & ~last) + 1  # the second blocks of windows
        block_pull[second] += pull[second - 1]
    return np.repeat(block_pull, length), error


def train(texts: Iterable[str], labels: Iterable[int], settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    """A number for each embedding row and one for all: a text's logit is that one and the means over its words and its window.

    Full-batch Adam on the cross entropy of the texts; in the first rounds the mean of all windows takes the place of the
    most toxic one, so that no window decides before anything is learnt. Texts without words teach only
    the share of toxic texts. With one class or no text at all, the scores are that share throughout.
    """
    vocabulary = Vocabulary()
    kept = [vocabulary.add(text) for text in texts]
    labels = np.array([*labels], np.float64)  # which may have grown with the texts
    share = (labels.sum() + 0.5) / (len(labels) + 2)  # a quarter if nothing is known, so that nothing is called toxic then
    bias = float(np.log(share / (1 - share)))
    used = np.array([len(k) > 0 for k in kept], bool)
    y = labels[used] if len(labels) else labels
    if not used.any() or len(set(y.tolist())) < 2:
        return np.zeros(settings.rows), bias
    parts = [*_parts([k for k in kept if len(k)], y)]
    del kept
    blocks, rows = _gram_blocks([*vocabulary], settings)
    size = len(vocabulary)
    del vocabulary

    draw = np.random.default_rng(settings.seed)
    # Single precision: the table, its moments and its temporary arrays are most of what training holds.
    table = draw.normal(0, 0.1, (len(rows), settings.size)).astype(np.float32)
    layer = draw.normal(0, 0.1, (settings.size, 2)).astype(np.float32)
    offset = np.array([0.0, bias])
    weights = [table, layer, offset]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]

    for step in range(1, settings.rounds + 1):
        row_logits = table @ layer
        row_margin = row_logits[:, 1] - row_logits[:, 0]
        margin = np.concatenate([np.add.reduceat(row_margin[at], np.cumsum(n) - n, dtype=np.float64) / n for _, at, n in blocks])
        word_pull, pulled = np.zeros(size), 0.0
        for words, sizes, toxic in parts:
            pull, error = _pulls(margin[words], sizes, toxic, offset[1] - offset[0], settings.window, step <= settings.rounds // 6)
            word_pull += np.bincount(words, pull / len(y), minlength=size)
            pulled += error.sum() / len(y)
        row_pull = np.zeros(len(rows))
        for begin, at, n in blocks:
            row_pull += np.bincount(at, np.repeat(word_pull[begin : begin + len(n)] / n, n), minlength=len(rows))
        both = np.stack([-row_pull, row_pull], axis=1).astype(np.float32)
        total = np.array([-pulled, pulled])
        pulls = both @ layer.T
        pulls += np.float32(settings.decay / len(y)) * table
        for (m, v), w, g in zip(moments, weights, [pulls, table.T @ both, total], strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            np.square(g, out=g)
            v += 0.01 * g
            slope = np.sqrt(v / (1 - 0.99**step))
            slope += 1e-8
            w -= settings.rate / (1 - 0.9**step) * m / slope
        del both, pulls, g, slope
    numbers = np.zeros(settings.rows)
    numbers[rows] = table @ (layer[:, 1] - layer[:, 0])
    return numbers, float(offset[1] - offset[0])


class Scorer:
    """Scores texts with the numbers of a trained model."""

    def __init__(self, numbers: np.ndarray, offset: float, settings: Settings):
        self.numbers, self.offset, self.settings, self.known = numbers, offset, settings, {}

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [*{*words}.difference(self.known)]
        if new:
            rows, owner = gram_rows(new, self.settings)
            sums = np.bincount(owner, self.numbers[rows]) / np.bincount(owner)
            self.known.update(zip(new, sums.tolist(), strict=True))

    def logits(self, texts: list[str]) -> np.ndarray:
        """The logit of each text; words not met before are hashed together."""
        found = [WORD.findall(t) for t in texts]
        words = [w for f in found for w in f]
        self._learn(words)
        out, sizes = np.full(len(texts), self.offset), np.array([len(f) for f in found])
        if words:
            first, length, last = blocks_of(sizes[sizes > 0], self.settings.window)
            values = np.fromiter(map(self.known.__getitem__, words), float, len(words))
            span = windows(length.astype(float), last, self.settings.window)
            sums = windows(np.add.reduceat(values, first), last, self.settings.window)
            means = np.divide(sums, span, out=np.full(len(sums), -np.inf), where=span > 0)
            starts = np.flatnonzero(np.append(True, last[:-1]))
            out[sizes > 0] += np.add.reduceat(values, first[starts]) / sizes[sizes > 0] + np.maximum.reduceat(means, starts)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -30, 30)))


def training_sample(
    docs: DataFrame, labels: DataFrame, settings: Settings, text: str = "text", doc_id: str = "doc_id", label: str = "toxic"
) -> DataFrame:
    """Labelled rows (_text, _label), within settings.sample and settings.characters, the same whatever the partitioning.

    Labels of no document do not count: ids of labels and documents, and nothing else, meet before any label is left out.
    """
    marks = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where(
        F.col("_label").isin(0, 1)
    )
    texts = docs.select(F.col(doc_id).alias("_id"), whole_text(text).alias("_text"))
    order = F.xxhash64(F.lit(settings.seed), "_id")
    known = marks.join(docs.select(F.col(doc_id).alias("_id")).distinct(), "_id", "left_semi")
    some = known.withColumn("_order", order).orderBy("_order", "_id", "_label").limit(settings.sample)
    # At most the sample of small rows, so the join needs no shuffle of texts.
    found = texts.join(F.broadcast(some), "_id").withColumn("_chars", F.length("_text"))
    few = found.select("_order", "_id", "_label", "_chars", F.xxhash64("_text").alias("_hash"))
    by = ["_order", "_id", "_label", "_hash"]
    few = few.orderBy(*by).limit(settings.sample)  # so the window's one task holds no more than that
    before = F.sum("_chars").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    ends = few.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < settings.characters)
    bound = ends.agg(F.max(F.struct(*by)).alias("x"), F.count("*").alias("n")).first()
    if not bound.n:
        return found.select("_text", "_label").limit(0)
    kinds = [few.schema[c].dataType for c in by]
    own = F.struct(*(F.col(c).alias(c) for c in by[:3]), F.xxhash64("_text").alias("_hash"))
    last = F.struct(*(F.lit(x).cast(k).alias(c) for x, k, c in zip(bound.x, kinds, by)))
    return found.where(own <= last).orderBy(own, "_text").limit(bound.n).select("_text", "_label")


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column | None = None, settings: Settings = Settings(), **names: str
) -> tuple[np.ndarray, float]:
    """Train on the labelled documents; `learn` says, over labels, which labels may be learnt from.

    Labels that are neither 0 nor 1, null ids and labels of no document teach nothing; an id that is labelled or occurs twice counts
    twice. Null texts are empty. Without any lesson all texts score a quarter. Other columns are ignored.
    """
    sample = training_sample(docs, labels if learn is None else labels.where(learn), settings, **names)
    marks: list[int] = []

    def texts() -> Iterator[str]:
        for row in sample.toLocalIterator():  # a text goes once its words are numbered
            marks.append(row._label)
            yield row._text

    model = train(texts(), marks, settings)
    give_back()
    return model


def with_score(
    docs: DataFrame,
    model: tuple[np.ndarray, float],
    settings: Settings = Settings(),
    text: str = "text",
    name: str = "toxicity",
) -> DataFrame:
    """docs with the double column `name` (replaced where docs has one): 0 to 1, higher for likelier toxic.

    The score reads the whole text and nothing else. Null, empty and wordless texts score the training share.
    Rows are independent; repeated rows, ties, other columns and an empty table need no care.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # settings.rows numbers, about a megabyte

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Scorer(*shared.value, settings)
        for part in slices(batches):
            yield pa.array(own.scores(part.to_pylist()))

    return docs.withColumn(name, scores(whole_text(text)))


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, float], limit: float = 0.5, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """The documents that score below the limit, with the columns of docs. Cases are as in `with_score`."""
    score = own_name(docs, "toxicity")
    return with_score(docs, model, settings, text, score).where(F.col(score) < limit).select(docs.columns)
