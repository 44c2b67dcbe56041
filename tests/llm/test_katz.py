import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenfold.llm import katz
from evenfold.llm.common import remainder_of_id

def learn():
    return remainder_of_id(F.col("doc_id"), 5) != 1


def plain_words(text):
    return (text or "").encode().lower().split()


class PlainKatz:
    """The model from counts in dictionaries, by its definition."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [collections.Counter() for _ in range(order + 1)]
        self.events, self.after = collections.Counter(), collections.defaultdict(set)
        for words in texts:
            padded = [b"<s>"] * (order - 1) + words + [None]
            for i in range(order - 1, len(padded)):
                for n in range(1, order + 1):
                    gram = tuple(padded[i - n + 1:i + 1])
                    self.counts[n][gram] += 1
                    if n > 1:
                        self.events[gram[:-1]] += 1
                        self.after[gram[:-1]].add(gram[-1])
        self.total, self.types = sum(self.counts[1].values()), len(self.counts[1])
        self.discounts = {n: katz.good_turing(np.array([sum(c == r for c in self.counts[n].values()) for r in range(1, katz.K + 2)])) for n in range(2, order + 1)}
        self.known = {}

    def discount(self, n, c):
        return self.discounts[n][c - 1] if c <= katz.K else 1.0

    def context(self, h):
        if h not in self.known:
            n = len(h) + 1
            freed = math.fsum((1 - self.discount(n, self.counts[n][(*h, w)])) * self.counts[n][(*h, w)] for w in self.after[h])
            events = self.events[h] if freed > 0 else self.events[h] + 1
            self.known[h] = events, (freed if freed > 0 else 1) / events / (1 - math.fsum(self.p(w, h[1:]) for w in self.after[h]))
        return self.known[h]

    def p(self, word, h):
        if not h:
            return (self.counts[1][(word,)] + 0.5) / (self.total + 0.5 * (self.types + 1))
        if not self.events[h]:
            return self.p(word, h[1:])
        events, weight = self.context(h)
        c = self.counts[len(h) + 1][(*h, word)]
        return self.discount(len(h) + 1, c) * c / events if c else weight * self.p(word, h[1:])

    def score(self, words, order):
        padded = [b"<s>"] * (order - 1) + words + [None]
        return math.fsum(math.log10(self.p(padded[i], tuple(padded[i - order + 1:i]))) for i in range(order - 1, len(padded)))


@pytest.mark.parametrize("order, hot", [(2, katz.HOT_EVENTS), (3, 40)])
def test_scores_are_those_of_plain_counts(spark, small, order, hot):
    docs = small.where("doc_id < 120").select("doc_id", "text").repartition(3)
    got = katz.scored(docs, learn(), order=order, block_chars=30_000, part_entries=20_000, hot_events=hot).collect()
    texts = {r.doc_id: plain_words(r.text) for r in docs.collect()}
    model = PlainKatz([w for k, w in texts.items() if zlib.crc32(str(k).encode()) % 5 != 1], order)
    assert len(got) == len(texts)
    for r in got:
        words = texts[r.doc_id]
        assert (r.n_tokens, r.train_tokens) == (len(words) + 1, model.total)
        assert r.n_known == sum((w,) in model.counts[1] for w in [*words, None])
        assert r.base_score == pytest.approx(model.score(words, 1), abs=1e-7)
        assert r.score == pytest.approx(model.score(words, order), abs=1e-7)


def test_probabilities_of_a_context_add_up(small):
    texts = [plain_words(r.text) for r in small.where("doc_id < 40").collect()]
    model = PlainKatz(texts, 2)
    for h in sorted(model.after, key=lambda h: -len(model.after[h]))[:3]:
        assert math.fsum(model.p(w, h) for (w,) in model.counts[1]) + model.p(b"\xff", h) == pytest.approx(1, abs=1e-9)


def test_hot_contexts_are_spread_without_a_change(spark, small):
    docs = small.select("doc_id", "text")
    one = {r.doc_id: r.score for r in katz.scored(docs, learn()).collect()}
    many = {r.doc_id: r.score for r in katz.scored(docs, learn(), block_chars=50_000, part_entries=10_000, hot_events=100).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-7 for k in one)


def test_edges(edges, nothing):
    got = katz.scored(edges, learn()).collect()
    assert len(got) == edges.count() and all(math.isfinite(r.score) and r.n_tokens >= 1 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert katz.scored(nothing, learn()).collect() == []
    untaught = katz.scored(edges, F.lit(False)).collect()
    assert {r.train_tokens for r in untaught} == {0} and all(r.score == pytest.approx(0) for r in untaught)


def test_discounts_without_good_counts_of_counts():
    assert katz.good_turing(np.zeros(katz.K + 1)) == pytest.approx(1 - 0.5 / np.arange(1, katz.K + 1))
    assert np.all(katz.good_turing(np.array([100, 40, 20, 12, 8, 5])) > 0)
