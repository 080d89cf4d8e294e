"""The toxicity scorer against a slow one, and what it must show of its method."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lorekeep.llm import quality, toxicity


def slow_logit(text, numbers, offset, settings):
    """One text by the definition: mean of all words, and the largest mean of a window of words."""
    found = toxicity.WORD.findall(text)
    if not found:
        return offset
    margins = []
    for word in found:
        rows, _ = toxicity.gram_rows([word], settings)
        margins.append(sum(numbers[r] for r in rows) / len(rows))
    step = max(1, settings.window // 2)
    wide = max(settings.window // 2 * 2, 1)
    likes = [margins[a : a + wide] for a in range(0, max(1, len(found) - wide + step), step)]
    return offset + sum(margins) / len(margins) + max(sum(x) / len(x) for x in likes)


@pytest.mark.parametrize("window", [1, 2, 3, 8, 16])
def test_scores_equal_those_of_a_slow_scorer(window):
    settings = toxicity.Settings(rows=512, window=window)
    numbers, draw = np.random.default_rng(window).normal(size=512), random.Random(window)
    texts = ["", " .,;", "one", "two words"]
    texts += [" ".join(f"w{draw.randrange(60)}" for _ in range(n)) for n in (3, 7, 8, 9, 15, 16, 17, 24, 25, 100)]
    found = toxicity.Scorer(numbers, 0.3, settings).logits(texts)
    assert found.tolist() == pytest.approx([slow_logit(t, numbers, 0.3, settings) for t in texts])
    assert toxicity.Scorer(numbers, 0.3, settings).logits([*reversed(texts)]).tolist() == pytest.approx(found[::-1].tolist())


def test_all_words_of_a_text_count():
    settings = toxicity.Settings(rows=512)
    scorer = toxicity.Scorer(np.random.default_rng(1).normal(size=512), 0.0, settings)
    plain, other = scorer.logits(["alpha beta gamma delta", "alpha beta gamma omega"])
    both, one = scorer.logits(["alpha beta", "alpha"])
    assert plain != other and both != one


def test_training_lowers_the_loss_and_knows_misspellings():
    draw = random.Random(3)
    made = []
    for i in range(400):
        words = ["".join(draw.choice("aeiounrst") for _ in range(6)) for _ in range(draw.randrange(5, 60))]
        if i % 4 == 0:
            words[draw.randrange(len(words))] = draw.choice(["dreadful", "horrible"])
        made.append((" ".join(words), int(i % 4 == 0)))
    settings = toxicity.Settings(rows=1 << 12)
    scorer = toxicity.Scorer(*toxicity.train([t for t, _ in made], [y for _, y in made], settings), settings)
    scores = scorer.scores([t for t, _ in made])
    loss = -np.mean([math.log(s if y else 1 - s) for s, (_, y) in zip(scores, made)])
    assert loss < 0.2  # of the share alone: 0.56
    assert scorer.scores(["dreadfull oh", "horible oh"]).min() > 0.5 > scorer.scores(["snoora oh"])[0]


def test_the_sample_is_bounded_by_characters(spark):
    docs = spark.createDataFrame([(i, "word " * 100) for i in range(50)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, None), (7, 5), (None, 1), (99, 1)], "doc_id long, toxic int")
    assert toxicity.training_sample(docs, labels, toxicity.Settings()).count() == 50
    part = toxicity.training_sample(docs, labels, toxicity.Settings(characters=5000)).collect()
    assert len(part) == 10 and {r._text for r in part} == {"word " * 100}
    assert toxicity.training_sample(docs, labels, toxicity.Settings(sample=7)).count() == 7
    assert toxicity.training_sample(docs, labels.where("false"), toxicity.Settings()).count() == 0


def test_labels_of_absent_documents_take_no_place(spark, monkeypatch):
    docs = spark.createDataFrame([(i * 500, f"text {i}") for i in range(100)], "doc_id long, text string")
    labels = spark.range(50_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic", "1 AS quality")
    found = toxicity.training_sample(docs, labels, toxicity.Settings(sample=200))
    assert found.count() == 100
    few = quality.Settings(sample=60)
    ratios = quality.fit(docs, labels, few)
    assert ratios.any() and not quality.fit(docs, labels.where("doc_id % 500 != 0"), few).any()
    seen = []
    counts = quality.ngram_counts
    monkeypatch.setattr(quality, "ngram_counts", lambda rows, settings: seen.append((rows.where("target").count(), rows.count())) or counts(rows, settings))
    quality.fit(docs, labels, few)
    assert seen == [(60, 100)]
