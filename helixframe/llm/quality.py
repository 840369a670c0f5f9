"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Each rule votes "good", "doubtful" or "bad" on a document, or abstains. Votes are independent given the unknown class; for each class and rule
the model holds how likely each vote is; abstaining says nothing. Bad documents fail in different ways, so there is a bad class for each
rule, the failure that it is about, beside the good one. Vote patterns are counted over all documents (at most 4 ** rules rows, whatever the
corpus), EM runs on those counts, and each document gets the posterior probability of being good of its own pattern.

A failure that only one rule sees can't be told from false alarms of that rule by votes alone: EM then calls whole kinds of junk good. What
rules are made for is stated as Dirichlet priors around the votes of each class, whose weight is a share of the class itself (parameters):
a good document rarely gets a doubtful vote and hardly ever a bad one, a failure mostly a bad one from its own rule, and other rules vote on it as they
do at large. The votes move all of these; how often each rule turns out right is `LabelModel.accuracy`. One doubtful vote among good ones keeps a document, a
bad one or several doubtful ones outweigh them.

No rule takes length for a fault, and variety is a mean over windows of `WINDOW` words that cover the whole text.

Null and empty texts have no words and fail the base rule. Repeated rows and ids are judged alike, as are all documents of one
vote pattern; a posterior equal to the threshold keeps. Very long texts are judged as a whole. An empty table gives an empty one.
Columns of the input keep their names: the column of results takes one that none has.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, Sequences, covered, fresh, mix, per_doc, slices, starts_of, word_table

_SPACE = word_table("space")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_ALPHA = word_table("alnum")
_ALPHA[0x30:0x3A] = False
_STRIP = bytes(SPACES)
WINDOW = 1000
_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha", "n_upper", "n_distinct"]


@F.arrow_udf(T.StructType([T.StructField(x, T.LongType()) for x in _FIELDS]))
def text_statistics(texts: pa.Array) -> pa.Array:
    """Counts over whole texts: words, their code points, symbols, repeated lines, words in repeated 5-word windows, lines with a word, letters, capitals, distinct words of each window of `WINDOW` words, summed."""
    parts: list[np.ndarray] = []
    for i, j, w in slices(texts, _SPACE):
        first, total = w.first, int(w.first[-1])
        lead = (w.data & 0xC0) != 0x80
        by_byte = lambda f: per_doc(f, w.offs)
        h = w.hashes()
        at = starts_of(first, 5)
        salt = mix(w.doc.astype(np.uint64) + np.uint64(1))
        key = Sequences(h).of(at, at + 5) ^ salt[at]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = at[twice]
        at_word = np.arange(total)
        window = at_word - (at_word - first[w.doc]) % WINDOW
        own = h ^ mix(window.astype(np.uint64) + np.uint64(1))
        order = np.argsort(own)
        new = np.ones(total, bool)
        new[order[1:]] = own[order][1:] != own[order][:-1]
        dup, lines = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
        for k in range(j - i):
            full = [x for x in w.data[w.offs[k] : w.offs[k + 1]].tobytes().split(b"\n") if x.strip(_STRIP)]
            lines[k], dup[k] = len(full), len(full) - len(set(full))
        parts.append(np.stack([w.counts, by_byte(w.on & lead), by_byte(_SYMBOL[w.data]), dup, per_doc(covered(total, hit, hit + 5), first), lines, by_byte(_ALPHA[w.data] & lead), by_byte(_UPPER[w.data]), per_doc(new, first)]))
    rows = np.concatenate(parts, axis=1) if parts else np.zeros((len(_FIELDS), 0), np.int64)
    return pa.StructArray.from_arrays([pa.array(r, pa.int64()) for r in rows], _FIELDS)


def base_failed(s: Column) -> Column:
    """Under ten words, or over a fifth of the words in repeated 5-word windows."""
    return (s.n_words < 10) | (100 * s.n_repeat_words > 20 * s.n_words)


#: Votes.
GOOD, ABSTAIN, DOUBTFUL, BAD = range(4)


def _vote(good: Column, doubtful: Column, bad: Column) -> Column:
    return F.when(bad, BAD).when(doubtful, DOUBTFUL).when(good, GOOD).otherwise(ABSTAIN)


def default_rules(s: Column) -> dict[str, Column]:
    """Each rule's vote from a document's statistics."""
    words, lines, chars = (F.greatest(x, F.lit(1)) for x in (s.n_words, s.n_lines, s.word_chars))
    long = s.n_words >= 50

    def share(n: Column, of: Column, good: int, doubtful: int, bad: int) -> Column:
        """By percent of n in `of`: good up to the first, doubtful above the second, bad above the third."""
        return _vote(100 * n <= good * of, 100 * n > doubtful * of, 100 * n > bad * of)

    few = F.when(s.n_words < 100, 30).otherwise(10) * words
    return {
        "length": _vote(long, s.n_words < 20, s.n_words < 10),
        "word_length": _vote((s.word_chars >= 3 * words) & (s.word_chars <= 8 * words), (s.word_chars < 3 * words) | (s.word_chars > 9 * words), (s.word_chars < 2 * words) | (s.word_chars > 12 * words)),
        "symbols": share(s.n_symbols, words, 2, 5, 10),
        "lines": share(s.n_dup_lines, lines, 0, 30, 50),
        "repetition": share(s.n_repeat_words, words, 5, 10, 20),
        "letters": _vote(100 * s.n_alpha >= 85 * chars, long & (100 * s.n_alpha < 80 * chars), long & (100 * s.n_alpha < 70 * chars)),
        "capitals": share(s.n_upper, chars, 10, 20, 30),
        "variety": _vote(4 * s.n_distinct > words, (s.n_words >= 20) & (200 * s.n_distinct < 3 * few), (s.n_words >= 20) & (100 * s.n_distinct < few)),
    }


class LabelModel:
    """Class 0 is good, the others bad; votes[c, r, v] is the probability of vote v (good, doubtful, bad) of rule r on class c, if it votes."""

    def __init__(self, prior: np.ndarray, votes: np.ndarray):
        self.prior, self.votes = prior, votes

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        """P(class) of each row of votes."""
        log = np.einsum("nrv,crv->nc", _said(patterns), np.log(self.votes)) + np.log(self.prior)
        p = np.exp(log - log.max(axis=1, keepdims=True)) if len(log) else log
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) of each row of votes."""
        return self.classes(patterns)[:, 0]

    def accuracy(self) -> np.ndarray:
        """How often each rule is right when it votes: not "bad" on good documents, "bad" on its own failure and not on others'."""
        own = 1 + np.arange(self.votes.shape[1])
        return 1 - self.prior[0] * self.votes[0, :, 2] - self.prior[own] * (1 - self.votes[own, own - 1, 2])


def _said(patterns: np.ndarray) -> np.ndarray:
    """Flags by pattern, rule and vote (good, doubtful, bad)."""
    return np.stack([patterns == v for v in (GOOD, DOUBTFUL, BAD)], axis=-1).astype(float)


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, *, good: tuple[float, float, float] = (0.89, 0.1, 0.01), failure: tuple[float, float, float] = (0.1, 0.2, 0.7), weight: float = 0.5, smooth: float = 0.5, rounds: int = 2000, tolerance: float = 1e-9) -> LabelModel:
    """EM over vote patterns and their counts, to the maximum a posteriori.

    `good` and `failure` are the prior votes (good, doubtful, bad) on good documents and of a failure's own rule; other rules' prior votes on a
    failure are those they cast at large. Each prior counts as `weight` times the documents of its class, and `smooth` more.
    """
    n, r = patterns.shape
    said = _said(patterns)
    at_large = np.einsum("n,nrv->rv", counts, said) + smooth
    mean = np.tile(at_large / at_large.sum(axis=1, keepdims=True), (1 + r, 1, 1))
    mean[0] = good
    mean[1 + np.arange(r), np.arange(r)] = failure
    prior = np.full(1 + r, 0.5 / r)
    prior[0] = 0.5
    model = LabelModel(prior, mean.copy())
    for _ in range(rounds if n else 0):
        share = model.classes(patterns) * counts[:, None]
        size = share.sum(axis=0)
        seen = np.einsum("nc,nrv->crv", share, said) + mean * (smooth + weight * size)[:, None, None]
        new = (size + smooth) / (counts.sum() + smooth * (1 + r))
        moved = np.abs(new - model.prior).max()
        model = LabelModel(new, seen / seen.sum(axis=2, keepdims=True))
        if moved < tolerance:
            break
    return model


def judge(docs: DataFrame, *, text_col: str = "text", statistics: str | None = None, rules: Callable[[Column], dict[str, Column]] = default_rules, threshold: float = 0.5) -> tuple[DataFrame, str]:
    """`docs` with a struct column (statistics, base_failed, pattern, posterior, kept); returns frame and column name.

    kept: the base rule holds and the posterior probability of good is at least `threshold`. Texts are read twice, once for
    the patterns and once for the rows; where a column `statistics` holds their `text_statistics` already, not at all.
    """
    name = fresh(docs, "quality")
    counts = text_statistics(F.col(text_col)) if statistics is None else F.col(statistics)
    votes = rules(F.col(name))
    if len(votes) > 8:
        raise ValueError("vote patterns are collected: at most 8 rules")
    code = sum(v * 4**k for k, v in enumerate(votes.values()))
    patterns = docs.select(counts.alias(name)).select(code.alias("p")).groupBy("p").count().collect()
    codes = np.array(sorted(r["p"] for r in patterns), np.int64)
    by_code = {r["p"]: r["count"] for r in patterns}
    table = (codes[:, None] // 4 ** np.arange(len(votes))[None, :]) % 4
    model = fit_label_model(table, np.array([by_code[c] for c in codes.tolist()], float))
    good = model.posterior(table) if len(codes) else np.zeros(0)

    @F.arrow_udf("double")
    def known(p: pa.Array) -> pa.Array:
        """The posterior of a pattern: at most 4 ** rules numbers go to each task."""
        return pa.array(good[np.searchsorted(codes, np.asarray(p))])

    out = docs.withColumn(name, counts)
    s = F.col(name)
    failed = base_failed(s)
    out = out.withColumn(name, F.struct(*[s[x].alias(x) for x in _FIELDS], failed.alias("base_failed"), code.cast("int").alias("pattern")))
    s = F.col(name)
    out = out.withColumn(name, s.withField("posterior", known(s.pattern)))
    return out.withColumn(name, F.col(name).withField("kept", ~F.col(name).base_failed & (F.col(name).posterior >= threshold))), name


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that `judge` keeps, with their own columns."""
    out, name = judge(docs, **options)
    return out.filter(F.col(name).kept).drop(name)
