"""Toxicity of obfuscated text by a noisy channel.

A word written in leetspeak, with marks between its letters, spaced out or with repeated letters is a lattice of
characters: each written character can stand for one of a few letters or for none, at a cost. ``Channel.restore``
finds the cheapest path by Viterbi decoding under a trigram model of characters that is counted over all texts. Words
without anything to restore have a single path and are taken as they are.

Restored words are scored by what their beginnings say: for whole words and for prefixes of 3 to 8 letters, the log
odds of standing in a toxic document, learned from labelled rows. A document's probability comes from a logistic
regression on its highest word scores and on how many words score at all.

Only a bounded sample of labelled rows is learned from: the ``most_labelled`` rows of each label that come first by a
hash of the doc_id. Everything else covers all rows and whole texts. The model is bounded by ``most_features`` and by
the alphabet, whatever the size of the data, so it is sent to the tasks as it is.

A word can score only if its lattice has a path to a feature, which a walk through a trie of the features finds before
anything is decoded; only words that pass are.

Missing or empty texts score as texts without toxic words. Texts of any length are scored whole; time is linear in the
length of a word, memory grows with its square root where masks follow each other. Other columns stay as they are. Without rows of both labels the score is the share of
toxic ones (one half without any). Repeated rows are scored each; a doc_id with several labels counts for each.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.remember import forget
from mailsieve.plans.session import materialize


@dataclass(frozen=True)
class ToxicityRules:
    most_labelled: int = 4000
    most_features: int = 50_000
    least_toxic: int = 3
    least_odds: float = 1.0
    remembered: int = 250_000


#: Letters that a written character can stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "¢": "c", "¥": "y", "§": "s",
}
ANY_LETTER = "*"
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ"
_CODE = {c: i + 1 for i, c in enumerate(_LETTERS)}
_SIZE = 64  # 0: outside of a word; 63: other letters
_OTHER = 63
_TABLE = np.zeros(65_536, np.uint8)
for _c in range(65_536):
    _TABLE[_c] = _CODE.get(chr(_c), _OTHER if chr(_c).isalpha() else 0)
_EDGES = ".,;:!?\"'()[]{}<>…%&#~^`«»„“”‚‘’|*=/\\"
#: Edges that stand for nothing but a mark; the others may be letters.
_MARKS = "".join(c for c in _EDGES if c not in LOOKS_LIKE and c != ANY_LETTER)
#: Words with more than one path, or with marks inside: leet or masked characters, equal letters side by side.
_ODD = re.compile(rf"[{re.escape(''.join(LOOKS_LIKE) + ANY_LETTER)}]|([^\W\d_])\1|[^\W_][\W_]+[^\W_]")
_REPEATED = re.compile(r"([^\W\d_])\1{3,}")
#: Three masks with no letter between them: more states than a dictionary serves well.
_MASKED_RUN = re.compile(r"\*(?:[^\w*]*\*){2}")
_SPACED = re.compile(r"(?:(?<=\s)|^)\S(?:\s++\S){2,}(?=\s|$)", re.MULTILINE)


_PART = 1 << 18


def trigram_counts(docs: DataFrame) -> DataFrame:
    """gram (three character codes in one number) and n, over all texts; at most 64^3 rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        counts = np.zeros(_SIZE ** 3, np.int64)

        def add(text: str) -> None:
            points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            code = _TABLE[np.minimum(points, 65_535)].astype(np.int32)
            grams = (code[:-2] << 12) | (code[1:-1] << 6) | code[2:]
            if len(grams):
                counts[:] += np.bincount(grams, minlength=len(counts))

        for batch in batches:
            waiting, size = [], 0
            for text in batch["text"]:
                for at in range(0, len(text or ""), _PART):
                    waiting.append(text[max(0, at - 2):at + _PART])
                    size += len(waiting[-1])
                    if size >= _PART:
                        add("\n\n".join(waiting))
                        waiting, size = [], 0
            add("\n\n".join(waiting))
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"gram": seen.astype(np.int32), "n": counts[seen]})

    found = docs.select(F.col("text").cast("string")).mapInPandas(run, "gram int, n long")
    return found.groupBy("gram").agg(F.sum("n").alias("n"))


class Channel:
    """Restores written words: a source of letters (trigram model) seen through a channel of substitutions."""

    SUBSTITUTED, DROPPED_MARK, DROPPED_LEET, DROPPED_REPEAT, MASKED, DROPPED_MASK = 0.7, 0.7, 9.0, 2.5, 2.0, 5.0
    #: steps between two stored rows of costs where all states are kept in arrays
    BLOCK = 256

    def __init__(self, counts: np.ndarray):
        cube = counts.reshape(_SIZE, _SIZE, _SIZE).astype(np.float64)
        pairs, single = cube.sum(axis=0), cube.sum(axis=(0, 1))
        unigram = (single + 1) / (single.sum() + _SIZE)
        bigram = (pairs + 10 * unigram) / (pairs.sum(axis=1, keepdims=True) + 10)
        self.cost = -np.log((cube + 10 * bigram[None]) / (cube.sum(axis=2, keepdims=True) + 10)).astype(np.float32)
        self.flat = self.cost.ravel().tolist()
        self.known_readings: dict[tuple[str, bool], list[tuple[str, int, float]]] = {}

    def lattice(self, written: str) -> list[list[tuple[str, int, float]]]:
        """The readings of each character. More than three equal letters count as three; masks never do."""
        written = _REPEATED.sub(r"\1\1\1", written)
        return [self._coded(c, before) for before, c in zip(["", *written], written)]

    def _coded(self, c: str, before: str) -> list[tuple[str, int, float]]:
        """Readings with the letter's code, -1 for none."""
        out = self.known_readings.get(key := (c, c == before))
        if out is None:
            out = [(x, _CODE.get(x, _OTHER) if x else -1, price) for x, price in self._readings(c, before)]
            self.known_readings[key] = out
        return out

    def _readings(self, c: str, before: str) -> list[tuple[str, float]]:
        if c.isalpha():
            return [(c, 0.0), ("", self.DROPPED_REPEAT)] if c == before else [(c, 0.0)]
        if c in LOOKS_LIKE:
            out = [(x, self.SUBSTITUTED) for x in LOOKS_LIKE[c]]
            return [*out, ("", self.DROPPED_REPEAT if c == before else self.DROPPED_LEET)]
        if c == ANY_LETTER:
            return [*((x, self.MASKED) for x in _LETTERS[:26]), ("", self.DROPPED_MASK)]
        return [("", self.DROPPED_MARK)]

    def restore(self, written: str) -> str:
        """The cheapest reading. A state is the last two letters. All states go on: few without masks, up to 64 x 64
        where masked letters follow each other, and then in arrays."""
        steps = self.lattice(written)
        if _MASKED_RUN.search(written):
            return self._restore_masked(steps)
        cost = self.flat
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # by both codes in one number
        for readings in steps:
            after: dict[int, tuple[float, tuple | None]] = {}
            for state, (paid, path) in states.items():
                for letter, k, price in readings:
                    if k >= 0:
                        gram = state << 6 | k
                        to, total = gram & 4095, paid + price + cost[gram]
                    else:
                        to, total = state, paid + price
                    if to not in after or total < after[to][0]:
                        after[to] = total, (path, letter) if k >= 0 else path
            states = after
        path = min(states.items(), key=lambda s: s[1][0] + cost[s[0] << 6])[1][1]
        letters = []
        while path is not None:
            path, letter = path
            letters.append(letter)
        return "".join(reversed(letters))

    def _step(self, paid: np.ndarray, readings: list[tuple[str, int, float]]) -> tuple[np.ndarray, np.ndarray]:
        """Costs of all states (letter before, last letter) after a character, and where each comes from: the letter
        before the two, or -1 where nothing was read."""
        after, back = np.full((_SIZE, _SIZE), np.inf), np.full((_SIZE, _SIZE), -1, np.int8)
        letters = [(k, price) for _, k, price in readings if k >= 0]
        for _, k, price in readings:
            if k < 0:
                after = paid + price
        if letters:
            codes, prices = np.array([k for k, _ in letters]), np.array([p for _, p in letters])
            live = np.isfinite(paid)
            one, two = np.flatnonzero(live.any(axis=1)), np.flatnonzero(live.any(axis=0))
            ways = paid[np.ix_(one, two)][:, :, None] + self.cost[np.ix_(one, two, codes)]
            best = ways.argmin(axis=0)
            total = np.take_along_axis(ways, best[None], axis=0)[0] + prices
            at = np.ix_(two, codes)
            better = total < after[at]
            after[at] = np.where(better, total, after[at])
            back[at] = np.where(better, one[best], -1)
        return after, back

    def _restore_masked(self, steps: list[list[tuple[str, int, float]]]) -> str:
        """Costs are stored every ``BLOCK`` steps; on the way back a block is computed again, so a long word needs
        little memory."""
        paid = np.full((_SIZE, _SIZE), np.inf)
        paid[0, 0] = 0.0
        stored, backs = [], []
        for i, readings in enumerate(steps):
            if i % self.BLOCK == 0:
                stored.append(paid)
                backs = []
            paid, back = self._step(paid, readings)
            backs.append(back)
        before, last = divmod(int((paid + self.cost[:, :, 0]).argmin()), _SIZE)
        letters = []
        for block in reversed(range(len(stored))):
            inside = steps[block * self.BLOCK:(block + 1) * self.BLOCK]
            if block < len(stored) - 1:  # the last block's are still there
                paid, backs = stored[block], []
                for readings in inside:
                    paid, back = self._step(paid, readings)
                    backs.append(back)
            for readings, back in zip(reversed(inside), reversed(backs)):
                earlier = int(back[before, last])
                if earlier >= 0:
                    letters.append(next(x for x, k, _ in readings if k == last))
                    before, last = earlier, before
        return "".join(reversed(letters))


def features_of(word: str) -> list[str]:
    """The whole word, marked by a closing blank, and its prefixes of 3 to 8 letters."""
    return [f"{word} ", *[word[:n] for n in range(3, min(8, len(word)) + 1)]]


@dataclass
class Reader:
    """The restored words of texts."""
    channel: Channel

    def written(self, token: str) -> tuple[tuple[str, ...], list[str]]:
        """The word as it stands, if it is one, and the forms of the token that may hide one. Masks alone hide none."""
        plain = token.strip(_EDGES)
        found = (plain,) if plain and plain[0].isalpha() or plain[1:2].isalpha() else ()
        forms = dict.fromkeys((plain, token.strip(_MARKS)))  # edges like "!" and "*" may be letters, too
        return found, [f for f in forms if _ODD.search(f) and any(c.isalpha() or c in LOOKS_LIKE for c in f)]

    def readings(self, token: str) -> tuple[str, ...]:
        found, forms = self.written(token)
        for form in forms:
            restored = self.channel.restore(form)
            found = (*found, restored) if restored and restored not in found else found
        return found

    def tokens(self, text: str | None) -> tuple[set[str], list[str]]:
        """Written tokens in lower case, and what runs of single characters restore to."""
        if not text:
            return set(), []
        text = text.lower()
        runs = [self.channel.restore("".join(m.group().split())) for m in _SPACED.finditer(text) if any(map(str.isalpha, m.group()))]
        return set(text.split()), runs

    def words(self, text: str | None) -> set[str]:
        tokens, runs = self.tokens(text)
        out = {w for t in tokens for w in self.readings(t)}
        return out.union(*([r[i:i + 24] for i in range(max(1, len(r) - 2))] for r in map(str, runs)))


@dataclass(frozen=True)
class ToxicityModel:
    counts: np.ndarray  # trigrams
    odds: dict[str, float]
    weights: np.ndarray  # intercept, then one for each pooled value


POOLED = 5


def pooled(scores: list[float], n_tokens: int) -> list[float]:
    top = heapq.nlargest(3, scores)
    return [*top, *[0.0] * (3 - len(top)), math.log1p(len(scores)), len(scores) / (n_tokens + 20.0) * 10]


class FeatureTrie:
    """The features as a trie: which lattices have a path to one at all."""

    def __init__(self, features):
        self.children: list[dict[str, int]] = [{}]
        self.prefix, self.whole = [False], [False]
        for feature in features:
            at = 0
            for letter in feature.rstrip(" "):
                nxt = self.children[at].get(letter)
                if nxt is None:
                    nxt = self.children[at][letter] = len(self.children)
                    self.children.append({})
                    self.prefix.append(False)
                    self.whole.append(False)
                at = nxt
            (self.whole if feature.endswith(" ") else self.prefix)[at] = True

    def reached(self, steps: list[list[tuple[str, int, float]]]) -> bool:
        """Whether any path, cheapest or not, has a feature: without one the word's score is 0 whatever it restores to."""
        nodes, children, prefix = {0}, self.children, self.prefix
        for readings in steps:
            after = set()
            for letter, k, _ in readings:
                if k < 0:
                    after |= nodes
                    continue
                for node in nodes:
                    to = children[node].get(letter)
                    if to is not None:
                        if prefix[to]:
                            return True
                        after.add(to)
            if not after:
                return False
            nodes = after
        return any(self.whole[n] for n in nodes)


class Scorer:
    """Scores of texts. Word scores are remembered in two generations of ``remembered`` / 2: when the young one is full
    it becomes the old one, and what was not looked up since is forgotten."""

    def __init__(self, model: ToxicityModel, remembered: int = 250_000):
        self.reader, self.odds, self.weights = Reader(Channel(model.counts)), model.odds, model.weights
        self.trie = FeatureTrie(model.odds)
        self.known: dict[str, float] = {}
        self.old: dict[str, float] = {}
        self.remembered = remembered // 2

    def word(self, word: str) -> float:
        get = self.odds.get
        return max((get(f, 0.0) for f in features_of(word)), default=0.0)

    def _token(self, token: str) -> float:
        """Of a token without the marks around it."""
        found = self.old.get(token)
        if found is None:
            plain, forms = self.reader.written(token)
            channel = self.reader.channel
            words = [*plain, *(channel.restore(f) for f in forms if self.trie.reached(channel.lattice(f)))]
            found = max(map(self.word, words), default=0.0)
        if len(self.known) >= self.remembered:
            self.old, self.known = self.known, {}
        self.known[token] = found
        return found

    def pooled(self, text: str | None) -> list[float]:
        tokens, runs = self.reader.tokens(text)
        known, new = self.known.get, self._token
        scores = [s for t in tokens if (s := new(c) if (k := known(c := t.strip(_MARKS))) is None else k)]
        for run in runs:
            best = max((self.word(run[i:i + 24]) for i in range(max(1, len(run) - 2))), default=0.0)
            if best:
                scores.append(best)
        return pooled(scores, len(tokens))

    def score(self, text: str | None) -> float:
        z = self.weights[0] + float(np.dot(self.weights[1:], self.pooled(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, toxic_share: float, ridge: float = 1.0) -> np.ndarray:
    """Weights by Newton's method, the intercept first. The labels weigh as in all labelled rows, of which
    ``toxic_share`` are toxic, so that one half is where toxic becomes the likelier label."""
    x = np.column_stack([np.ones(len(x)), x])
    share = np.where(y == 1, toxic_share / max(y.sum(), 1), (1 - toxic_share) / max((1 - y).sum(), 1)) * len(y)
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + penalty * w
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, rules: ToxicityRules = ToxicityRules()) -> ToxicityModel:
    """``may_learn`` is a condition on doc_id. The log odds and the regression learn from the same rows; for the
    regression, each row is scored with log odds from which its own share is taken away."""
    spark = docs.sparkSession
    counts = np.zeros(_SIZE ** 3, np.int64)
    for gram, n in trigram_counts(docs).collect():  # bounded by the alphabet
        counts[gram] = n
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(may_learn & F.col("toxic").isin(0, 1))
    sample = None
    for label in (0, 1):
        some = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.most_labelled)
        sample = some if sample is None else sample.unionByName(some)
    sample = materialize(sample, "labelled")
    # at most 2 * most_labelled rows of three small columns
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")
    chosen = materialize(chosen, "labelled-texts")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(Channel(counts))
        reader.readings = functools.lru_cache(rules.most_features)(reader.readings)
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                found = sorted({f for w in reader.words(text) for f in features_of(w)})
                yield pd.DataFrame({"feature": pd.Series(found, dtype="object"), "toxic": int(toxic)})

    n_clean, n_toxic = (chosen.where(F.col("toxic") == label).count() for label in (0, 1))
    strength = F.col("t") * F.log((F.col("t") + 0.5) * (n_clean + 1.0) / ((F.col("c") + 0.5) * (n_toxic + 1.0)))
    grouped = (
        chosen.mapInPandas(features, "feature string, toxic int").groupBy("feature")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where(F.col("t") >= rules.least_toxic)
        .where(strength >= rules.least_odds).orderBy(F.desc(strength), "feature").limit(rules.most_features))
    seen = grouped.collect() if n_clean and n_toxic else []  # bounded by most_features

    def odds(label: int | None = None) -> dict[str, float]:
        """Log odds of the features; with a label, as if one row of that label that has the feature were not there."""
        less_t, less_c = int(label == 1), int(label == 0)
        out = {}
        for f, t, c in seen:
            t, c = t - less_t, max(0, c - less_c)
            value = math.log((t + 0.5) / (n_toxic - less_t + 1)) - math.log((c + 0.5) / (n_clean - less_c + 1))
            if t >= rules.least_toxic and value >= rules.least_odds:
                out[f] = value
        return out

    found = odds()
    drafts = [ToxicityModel(counts, odds(label), np.zeros(POOLED + 1)) for label in (0, 1)]
    shipped = spark.sparkContext.broadcast(drafts)

    def pools(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(m, rules.remembered) for m in shipped.value]
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "x": [scorers[y].pooled(t) for t, y in zip(batch["text"], batch["toxic"])]})

    rest = chosen.mapInPandas(pools, "toxic int, x array<double>").collect()  # bounded like the sample
    y = np.array([r["toxic"] for r in rest], float)
    if 0 < y.sum() < len(y):
        total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
        weights = logistic(np.array([r["x"] for r in rest]), y, total.get(1, 0) / sum(total.values()))
    else:
        weights = np.zeros(POOLED + 1)
        share = n_toxic / (n_toxic + n_clean) if n_toxic + n_clean else 0.5
        weights[0] = math.log((share + 1e-6) / (1 - share + 1e-6))
    return ToxicityModel(counts, found, weights)


def score(docs: DataFrame, model: ToxicityModel, rules: ToxicityRules = ToxicityRules(), output: str = "score",
          predicted: str = "predicted") -> DataFrame:
    """``docs`` with the columns ``output`` (0 to 1) and ``predicted`` (1 from 0.5 on), which take the place of columns
    of these names; only texts go to Python, one number comes back."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        scorer = Scorer(shipped.value, rules.remembered)
        for batch in batches:
            yield pd.Series([scorer.score(t) for t in batch], dtype="float64")

    scored = docs.drop(output, predicted).withColumn(output, run(F.col("text").cast("string")))
    return scored.withColumn(predicted, (F.col(output) >= 0.5).cast("int"))
