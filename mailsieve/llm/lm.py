"""Language-model scoring: exact unigram counts, and a gated recurrent model with a class-factored softmax.

Tokens are the words of a text with A-Z in lower case, then one end. ``unigrams`` counts all training tokens. ``train``
fits a GRU in numpy by truncated backpropagation: within a window gradients run back to its start, and the state goes
on from window to window through the whole text. The output is factored: first the class of the next token, then the
word within the class. Classes hold the most frequent tokens by rank; one last class stands for all others, whose share
within it comes from the exact counts, so every token of any vocabulary has a probability. ``score`` adds both
logarithms over each complete text.

At scale. Words travel as sorted arrays of 64-bit hashes packed by hash range and by chunk of documents, not as rows:
a range counts all tasks' words in one vector operation and hands each chunk the counts of its words, and a document
meets them in its chunk. So everything shuffled grows with the number of distinct words of each task, and no table of
all words is ever in one place. Documents are dealt to chunks of bounded size by a hash, which spreads any hot source
or group of copies. The GRU is trained by every task on its part of the training documents, in rounds after
each of which the parameters are averaged by weight, in groups first. The rounds are disjoint parts of all training
documents (``share`` = 1), so each of them is learned from once.

Missing or empty texts are one end token. Without training tokens every count is 0. Repeated rows count and are scored
each. Rows without doc_id count as doc_id ''.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.words import hash_words, utf8
from mailsieve.plans.session import materialize

END = np.uint64(0xE0D0E0D0E0D0E0D1)


@dataclass(frozen=True)
class ModelRules:
    hidden: int = 16
    class_size: int = 32
    classes: int = 32
    window: int = 32
    batch: int = 128
    rate: float = 0.015
    share: int = 1  # one training document in so many trains the GRU
    rounds: int = 2
    chunk_bytes: int = 24 << 20
    range_bytes: int = 8 << 20
    seed: int = 7


def _tokens(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``hash_words`` in lower case with the end token after each text."""
    for first, hashes, counts in hash_words(texts, lower=True):
        yield first, np.insert(hashes, np.cumsum(counts), END), counts + 1


class _Counter:
    """Distinct hashes with counts, merged in bounded steps."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray | None) -> None:
        seen, at, times = np.unique(hashes, return_inverse=True, return_counts=True)
        n = times.astype(np.float64) if counts is None else np.bincount(at, counts, minlength=len(seen))
        self.parts.append((seen, n))
        self.size += len(seen)
        if len(self.parts) > 1 and self.size > 2 * len(self.parts[0][0]) + 200_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0)
        if len(self.parts) > 1:
            hashes, counts = (np.concatenate(x) for x in zip(*self.parts))
            seen, at = np.unique(hashes, return_inverse=True)
            self.parts = [(seen, np.bincount(at, counts, minlength=len(seen)))]
            self.size = len(seen)
        return self.parts[0]


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


_RANGE = "chunk int, range int, hashes binary, counts binary"


def _packed_words(ranges: int):
    """For each chunk and hash range the distinct words of a task and how often its training texts have them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, _Counter] = {}

        def packed() -> Iterator[pd.DataFrame]:
            for chunk in sorted(held):
                hashes, counts = held[chunk].merge()
                limits = np.searchsorted(_range_of(hashes, ranges), np.arange(ranges + 1))
                rows = [(chunk, r, hashes[a:b].tobytes(), counts[a:b].astype(np.int64).tobytes())
                        for r, (a, b) in enumerate(zip(limits[:-1], limits[1:])) if b > a]
                yield pd.DataFrame(rows, columns=["chunk", "range", "hashes", "counts"])
            held.clear()

        for batch in batches:
            order = np.argsort(batch["chunk"].to_numpy(), kind="stable")
            batch = batch.iloc[order]
            for chunk, part in batch.groupby("chunk", sort=False):
                learned = part["learned"].to_numpy()
                for first, hashes, counts in _tokens([utf8(t) for t in part["text"]]):
                    weight = np.repeat(learned[first:first + len(counts)], counts).astype(np.float64)
                    held.setdefault(int(chunk), _Counter()).add(hashes, weight)
            if sum(c.size for c in held.values()) > 6_000_000:
                yield from packed()
        yield from packed()

    return run


_COUNTED = "kind string, chunk int, hashes binary, counts binary, tokens long, words long"


def _count_range(most: int):
    """All packed words of one hash range: the counts for each chunk, the totals, and the most frequent."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        chunks = part["chunk"].to_numpy()
        each = [np.frombuffer(h, np.uint64) for h in part["hashes"]]
        hashes, counts = np.concatenate(each), np.concatenate([np.frombuffer(c, np.int64) for c in part["counts"]])
        seen, at = np.unique(hashes, return_inverse=True)
        total = np.bincount(at, counts, minlength=len(seen)).astype(np.int64)
        rows = []
        owner = np.repeat(chunks, [len(e) for e in each])
        for chunk in np.unique(chunks):
            own = np.unique(at[owner == chunk])
            rows.append(("chunk", int(chunk), seen[own].tobytes(), total[own].tobytes(), 0, 0))
        top = np.lexsort((seen, -total))[:most]
        top = top[total[top] > 0]
        rows.append(("range", -1, seen[top].tobytes(), total[top].tobytes(), int(total.sum()), int((total > 0).sum())))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _COUNTED.split(", ")])

    return run


@dataclass(frozen=True)
class Unigrams:
    table: DataFrame  # counts for each chunk
    chunks: int
    tokens: int  # N
    words: int  # V
    frequent: np.ndarray  # hashes by rank
    frequent_counts: np.ndarray


def _chunk(chunks: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")


def _texts(docs: DataFrame, learned: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(learned, F.lit(True)).alias("learned"))


def unigrams(docs: DataFrame, rules: ModelRules) -> Unigrams:
    """``docs``: doc_id, text, learned."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, ranges = int(size // rules.chunk_bytes) + 1, int(size // rules.range_bytes) + 16
    most = rules.classes * rules.class_size
    packed = docs.select(_chunk(chunks).alias("chunk"), "text", "learned").mapInPandas(_packed_words(ranges), _RANGE)
    counted = materialize(packed.groupBy("range").applyInPandas(_count_range(most), _COUNTED), "counted")
    total = counted.where("kind = 'range'")
    n = total.agg(F.sum("tokens"), F.sum("words")).first()

    def flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for h, c in zip(batch["hashes"], batch["counts"]):
                yield pd.DataFrame({"hash": np.frombuffer(h, np.int64), "n": np.frombuffer(c, np.int64)})

    top = (total.select("hashes", "counts").mapInPandas(flat, "hash long, n long")
           .orderBy(F.desc("n"), "hash").limit(most).collect())  # bounded by the model's size
    frequent = {int(np.uint64(r[0] & 0xFFFFFFFFFFFFFFFF)): r[1] for r in top}
    hashes = np.array(list(frequent), np.uint64)
    return Unigrams(counted.where("kind = 'chunk'").select("chunk", "hashes", "counts"), chunks, n[0] or 0, n[1] or 0,
                    hashes, np.array(list(frequent.values()), np.int64))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.exp(-x)
    e += 1
    return np.divide(1, e, out=e)


class Gru:
    """Parameters as float32 arrays: table (input gates for each token and the start), recurrent, class and word
    outputs. Token ids: 0.. by rank, then the id of all other tokens; the start comes last."""

    def __init__(self, counts: np.ndarray, tokens: int, rules: ModelRules):
        self.rules = rules
        self.size = max(1, -(-len(counts) // rules.class_size)) * rules.class_size
        self.n_classes = self.size // rules.class_size + 1
        rng = np.random.default_rng(rules.seed)
        h = rules.hidden
        known = np.concatenate([counts, np.zeros(self.size - len(counts))]) + 0.5
        by_class = np.append(known.reshape(-1, rules.class_size).sum(axis=1), max(0.0, tokens - counts.sum()) + 0.5)
        self.parameters = {
            "table": rng.normal(0, 0.3, (self.size + 2, 3 * h)), "recurrent": rng.normal(0, 0.3, (h, 3 * h)),
            "class_out": rng.normal(0, 0.05, (h, self.n_classes)), "class_bias": np.log(by_class / by_class.sum()),
            "word_out": rng.normal(0, 0.05, (self.size, h)), "word_bias": np.log(known)}
        self.parameters = {k: v.astype(np.float32) for k, v in self.parameters.items()}

    @property
    def other(self) -> int:
        return self.size

    @property
    def start(self) -> int:
        return self.size + 1

    def step(self, token: np.ndarray, h: np.ndarray):
        return self.step_from(self.parameters["table"][token], h)

    def step_from(self, a: np.ndarray, h: np.ndarray):
        """``a``: the rows of the table."""
        n = self.rules.hidden
        u = h @ self.parameters["recurrent"]
        gates = _sigmoid(a[:, :2 * n] + u[:, :2 * n])
        z, r = gates[:, :n], gates[:, n:]
        new = r * u[:, 2 * n:]
        new += a[:, 2 * n:]
        np.tanh(new, out=new)
        after = h - new
        after *= z
        after += new
        return after, (gates, new, u[:, 2 * n:])

    def outputs(self, h: np.ndarray, target: np.ndarray, learn: bool = False):
        """Log probability of each target; with ``learn`` also the gradients of its negative sum."""
        p, k = self.parameters, self.rules.class_size
        logits = h @ p["class_out"] + p["class_bias"]
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        total = e.sum(axis=1)
        kind = target // k
        rows = np.arange(len(target))
        out = logits[rows, kind] - np.log(total)
        gradient = {}
        if learn:
            d = e / total[:, None]
            d[rows, kind] -= 1
            gradient = {"class_out": h.T @ d, "class_bias": d.sum(axis=0), "word_out": np.zeros_like(p["word_out"]),
                        "word_bias": np.zeros_like(p["word_bias"])}
            back = d @ p["class_out"].T
        order = np.argsort(kind.astype(np.int16) if self.n_classes < 30_000 else kind, kind="stable")
        limits = np.searchsorted(kind[order], np.arange(self.n_classes))
        order = order[:limits[-1]]  # the last class has no words
        seen = [(c, a, b) for c, (a, b) in enumerate(zip(limits[:-1].tolist(), limits[1:].tolist())) if b > a]
        word_out, sorted_h, sorted_kind = p["word_out"].reshape(-1, k, h.shape[1]), h[order], kind[order]
        inner = p["word_bias"].reshape(-1, k)[sorted_kind]
        for c, a, b in seen:
            inner[a:b] += sorted_h[a:b] @ word_out[c].T
        inner -= inner.max(axis=1, keepdims=True)
        place, own = np.arange(len(order)), target[order] - sorted_kind * k
        picked = inner[place, own]
        e = np.exp(inner, out=inner)
        total = e.sum(axis=1)
        out[order] += picked - np.log(total)
        if learn and seen:
            e /= total[:, None]
            e[place, own] -= 1
            below, to_words = np.empty_like(sorted_h), gradient["word_out"].reshape(word_out.shape)
            for c, a, b in seen:
                np.matmul(e[a:b].T, sorted_h[a:b], out=to_words[c])
                np.matmul(e[a:b], word_out[c], out=below[a:b])
            gradient["word_bias"].reshape(-1, k)[[c for c, _, _ in seen]] = np.add.reduceat(e, [a for _, a, _ in seen], axis=0)
            back[order] += below
        return (out, back, gradient) if learn else (out, None, None)

    def log_probabilities(self, texts: list[np.ndarray], together: int = 2048, window: int = 64) -> np.ndarray:
        """Natural log probability of each whole text of token ids; the state is carried across windows."""
        out = np.zeros(len(texts))
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        for first in range(0, len(order), together):
            own = order[first:first + together]
            length = lengths[own]
            h = np.zeros((len(own), self.rules.hidden), np.float32)
            before = np.full(len(own), self.start)
            for at in range(0, int(length[0]) if len(own) else 0, window):
                states, targets, owners = [], [], []
                active = int(np.searchsorted(-length, -at, "left"))
                part = np.full((active, window), self.other, np.int64)
                for i in range(active):
                    piece = texts[own[i]][at:at + window]
                    part[i, :len(piece)] = piece
                for t in range(min(window, int(length[0]) - at)):
                    n = int(np.searchsorted(-length, -(at + t), "left"))
                    h[:n] = self.step(before[:n], h[:n])[0]
                    before[:n] = part[:n, t]
                    states.append(h[:n].copy())
                    targets.append(part[:n, t])
                    owners.append(np.arange(n))
                states, targets = np.concatenate(states), np.concatenate(targets)
                got = np.concatenate([self.outputs(states[i:i + 4096], targets[i:i + 4096])[0] for i in range(0, len(targets), 4096)])
                out[own] += np.bincount(np.concatenate(owners), got, minlength=len(own))
        return out


class Trainer:
    """Truncated backpropagation with Adam over groups of texts of similar length."""

    def __init__(self, model: Gru):
        self.model, self.steps, self.tokens = model, 0, 0
        self.m = {k: np.zeros_like(v) for k, v in model.parameters.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.parameters.items()}

    def _window(self, part: np.ndarray, inputs: np.ndarray, active: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One window of texts sorted by length: part (texts x steps) are the targets, active the texts at each step."""
        model, n = self.model, self.model.rules.hidden
        p = model.parameters
        ends = np.cumsum(active)
        starts = ends - active
        # all rows of the window, step by step
        tokens = np.concatenate([inputs[:m, t] for t, m in enumerate(active)])
        targets = np.concatenate([part[:m, t] for t, m in enumerate(active)])
        read = p["table"][tokens]
        before, states, new, u = (np.empty((ends[-1], n), np.float32) for _ in range(4))
        gates = np.empty((ends[-1], 2 * n), np.float32)
        for a, b, m in zip(starts, ends, active):
            before[a:b] = h[:m]
            h[:m], (gates[a:b], new[a:b], u[a:b]) = model.step_from(read[a:b], before[a:b])
            states[a:b] = h[:m]
        _, back, gradient = model.outputs(states, targets, learn=True)
        z, r = gates[:, :n], gates[:, n:]
        # what each gate passes on for one unit from above: of the update gate, of the reset gate and of the new state
        down = np.zeros((active[0], n), np.float32)
        pass_new = (1 - z) * (1 - new * new)
        each = np.stack([(before - new) * z * (1 - z), pass_new * u * r * (1 - r), pass_new * r], axis=1)
        d_u, turned = np.empty_like(each), np.ascontiguousarray(p["recurrent"].T)
        flat, d_all = d_u.reshape(-1, 3 * n), np.empty_like(back)
        for a, b, m in zip(starts[::-1], ends[::-1], active[::-1]):
            d = np.add(down[:m], back[a:b], out=d_all[a:b])
            np.multiply(each[a:b], d[:, None, :], out=d_u[a:b])
            down[:m] = d * z[a:b] + flat[a:b] @ turned
        gradient["recurrent"] = before.T @ flat
        d_u[:, 2] = d_all * pass_new
        order = np.argsort(tokens.astype(np.int16) if model.size < 30_000 else tokens, kind="stable")
        ordered = tokens[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        table = np.zeros_like(p["table"])
        table[ordered[first]] = np.add.reduceat(flat[order], first, axis=0)
        gradient["table"] = table
        self._update(gradient, len(targets))
        self.tokens += len(targets)
        return h

    def _update(self, gradient: dict[str, np.ndarray], n: int) -> None:
        self.steps += 1
        scale = np.float32(1 / n)
        norm = float(np.sqrt(sum(float((g * scale).ravel() @ (g * scale).ravel()) for g in gradient.values())))
        scale *= np.float32(min(1.0, 1.0 / max(norm, 1e-12)))
        for k, g in gradient.items():
            g = g * scale
            self.m[k] += np.float32(0.1) * (g - self.m[k])
            self.v[k] += np.float32(0.01) * (g * g - self.v[k])
            spread = self.v[k] * np.float32(1 / (1 - 0.99 ** self.steps))
            np.sqrt(spread, out=spread)
            spread += np.float32(1e-6)
            step = np.divide(self.m[k], spread, out=spread)
            step *= np.float32(self.model.rules.rate / (1 - 0.9 ** self.steps))
            self.model.parameters[k] = self.model.parameters[k] - step

    def learn(self, texts: list[np.ndarray]) -> None:
        rules = self.model.rules
        texts = sorted((t for t in texts if len(t)), key=len, reverse=True)
        for first in range(0, len(texts), rules.batch):
            group = texts[first:first + rules.batch]
            length = np.array([len(t) for t in group])
            h = np.zeros((len(group), rules.hidden), np.float32)
            last = np.full(len(group), self.model.start)
            for at in range(0, int(length[0]), rules.window):
                steps = min(rules.window, int(length[0]) - at)
                n = int((length > at).sum())
                part = np.full((n, steps), self.model.other, np.int64)
                for i in range(n):
                    piece = group[i][at:at + steps]
                    part[i, :len(piece)] = piece
                inputs = np.concatenate([last[:n, None], part[:, :-1]], axis=1)
                active = np.array([int((length > at + t).sum()) for t in range(steps)])
                h = self._window(part, inputs, active, h)
                last[:n] = part[:, -1]


def _ids(hashes: np.ndarray, ordered: np.ndarray, rank: np.ndarray, other: int) -> np.ndarray:
    """Rank of each hash among the frequent ones, ``other`` for the rest."""
    if not len(ordered):
        return np.full(len(hashes), other)
    at = np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)
    return np.where(ordered[at] == hashes, rank[at], other)


def _flat(model: Gru) -> bytes:
    return b"".join(model.parameters[k].tobytes() for k in sorted(model.parameters))


def _load(model: Gru, flat: np.ndarray) -> None:
    at = 0
    for k in sorted(model.parameters):
        size = model.parameters[k].size
        model.parameters[k] = flat[at:at + size].reshape(model.parameters[k].shape).astype(np.float32)
        at += size


def train(docs: DataFrame, found: Unigrams, rules: ModelRules) -> Gru:
    """``docs``: doc_id, text, learned. Rounds take disjoint parts, together all (of the share) that may be learned from."""
    model = Gru(found.frequent_counts, found.tokens, rules)
    rank = np.argsort(found.frequent, kind="stable")
    ordered = found.frequent[rank]
    bucket = F.pmod(F.xxhash64("doc_id", "text", F.lit("share")), F.lit(rules.share * rules.rounds))
    for number in range(rules.rounds):
        shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the model's size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = copy.deepcopy(shipped.value)  # a worker's next task starts from the round's parameters, too
            trainer, waiting = Trainer(own), []

            for batch in batches:
                for _, hashes, counts in _tokens([utf8(t) for t in batch["text"]]):
                    waiting += np.split(_ids(hashes, ordered, rank, own.other), np.cumsum(counts)[:-1])
                if len(waiting) >= 8 * rules.batch:
                    trainer.learn(waiting)
                    waiting = []
            trainer.learn(waiting)
            if trainer.tokens:
                yield pd.DataFrame({"part": [TaskContext.get().partitionId() % 16], "weight": [float(trainer.tokens)], "flat": [_flat(own)]})

        def mean(part: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(f, np.float32) * w for f, w in zip(part["flat"], part["weight"]))
            weight = part["weight"].sum()
            return pd.DataFrame({"part": [0], "weight": [weight], "flat": [(total / weight).astype(np.float32).tobytes()]})

        schema = "part int, weight double, flat binary"
        chosen = docs.where("learned").where(bucket == number).select("text")
        rows = chosen.mapInPandas(run, schema).groupBy("part").applyInPandas(mean, schema).collect()  # 16 at most
        if rows:
            weight = sum(r["weight"] for r in rows)
            _load(model, sum(np.frombuffer(r["flat"], np.float32) * (r["weight"] / weight) for r in rows))
    return model


SCORED = "doc_id string, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, found: Unigrams, model: Gru) -> DataFrame:
    """``SCORED`` (doc_id as long) for each row of ``docs`` (doc_id, text)."""
    rank = np.argsort(found.frequent, kind="stable")
    ordered = found.frequent[rank]
    n, v = found.tokens, found.words
    rest_tokens, rest_words = n - int(found.frequent_counts.sum()), v - len(found.frequent)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        gru = shipped.value
        hashes = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(h, np.uint64) for h in words["hashes"])])
        counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(c, np.int64) for c in words["counts"])])
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        ids = _ids(hashes, ordered, rank, gru.other)
        base = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
        beside = np.where(ids == gru.other, np.log((counts + 0.5) / (rest_tokens + 0.5 * (rest_words + 1))), 0.0)
        out = np.zeros((len(texts), 4))
        sequences: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        for first, tokens, lengths in _tokens([utf8(t) for t in texts["text"]]):
            at = np.searchsorted(hashes, tokens)
            starts = np.cumsum(lengths) - lengths
            rows = slice(first, first + len(lengths))
            out[rows, 0] = lengths
            for column, value in ((1, (counts > 0).astype(np.int64)), (2, base), (3, beside)):
                out[rows, column] = np.add.reduceat(value[at], starts)
            sequences[rows] = np.split(ids[at].astype(np.int16 if gru.size < 30_000 else np.int64), starts[1:])
        total = (gru.log_probabilities(sequences) + out[:, 3]) / np.log(10)
        return pd.DataFrame({
            "doc_id": texts["doc_id"], "n_tokens": out[:, 0].astype(np.int64), "n_known": out[:, 1].astype(np.int64), "train_tokens": n,
            "base_score": out[:, 2], "score": total})

    # ids travel as text: pandas would turn numbers beside a missing one into floats
    dealt = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", _chunk(found.chunks).alias("chunk"))
    scored_rows = dealt.groupBy("chunk").cogroup(found.table.groupBy("chunk")).applyInPandas(run, SCORED)
    return scored_rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def scored(docs: DataFrame, may_learn: Column, rules: ModelRules = ModelRules()) -> DataFrame:
    """Counts, trains on the rows that ``may_learn`` (a condition on doc_id) allows, and scores all rows."""
    texts = _texts(docs, may_learn)
    found = unigrams(texts, rules)
    return score(texts, found, train(texts, found, rules))
