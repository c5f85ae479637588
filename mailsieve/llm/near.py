"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification.

A text is the set of its windows of five lowercase words (all words, if it has fewer); two texts are linked if the
Jaccard similarity of their sets is 0.8 or more. ``near_classes`` gives each document its class, which is the least
doc_id that it is connected to over links, and the number of documents that it is linked to.

1. Equal texts are one node with a number of copies.
2. Bands of MinHash values put nodes into buckets; buckets that share nodes form a candidate group. With 35 bands of 5
   values, a pair of similarity 0.8 meets in none with a chance of 9e-7, and this falls fast above 0.8.
3. In a group, MinHash values are compared step by step. After each step, pairs go whose posterior probability of
   reaching the threshold (uniform prior, binomial evidence) is below ``tolerance``.
4. The remaining pairs are verified exactly on the sets.

No pair is ever a row: a group is cut into blocks, a task compares two blocks in arrays and returns for each node how
many documents it is linked to and one link towards its part's least node, so a group of any size is spread over many
tasks and gives as many rows as it has nodes and blocks. Hot buckets are aggregated before the shuffle, joins on them
can be split. Words and windows are compared by 64-bit hashes.

Missing and empty texts have no windows: they are linked to nothing and are their own class. Rows without doc_id have
no class and 0 links. Rows that repeat are copies; rows that share a doc_id but not the text are joined by their
links only. Other columns are not carried. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.components import components
from mailsieve.llm.remember import forget
from mailsieve.llm.words import hash_words, mix, utf8, windows
from mailsieve.plans.session import materialize


@dataclass(frozen=True)
class JaccardRules:
    words: int = 5
    similarity: float = 0.8
    bands: int = 35
    rows: int = 5
    compared: int = 64
    step: int = 16
    tolerance: float = 1e-6
    block: int = 2048

    def needed(self) -> list[tuple[int, int]]:
        """(values compared, least number of equal ones that keeps a pair). With a uniform prior, the posterior of
        n values of which m are equal gives P(similarity >= t) = P(Binomial(n + 1, t) <= m)."""
        out = []
        for n in range(self.step, self.compared + 1, self.step):
            total, m = 0.0, 0
            while True:
                total += math.comb(n + 1, m) * self.similarity ** m * (1 - self.similarity) ** (n + 1 - m)
                if total >= self.tolerance:
                    break
                m += 1
            out.append((n, m))
        return out


def _sets(texts: list[bytes], rules: JaccardRules) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first, windows, counts) like ``hash_words``, of the windows of each text; repeated ones still in."""
    for first, hashes, counts in hash_words(texts):
        ends = np.cumsum(counts)
        if (counts >= rules.words).all() and len(counts) == 1:
            found = windows(hashes, rules.words)
            yield first, found, np.array([len(found)])
            continue
        whole = windows(hashes, rules.words)
        inside = np.ones(len(whole), bool)
        for end in ends[:-1]:
            inside[max(0, end - rules.words + 1):end] = False
        short = np.flatnonzero((counts > 0) & (counts < rules.words))
        number = np.maximum(counts - rules.words + 1, 0)
        kept = whole[inside] if len(whole) else whole
        if len(short):
            own = [windows(hashes[ends[i] - counts[i]:ends[i]], int(counts[i])) for i in short]
            places = np.concatenate([[0], np.cumsum(number)])[short]
            kept = np.insert(kept, places, np.concatenate(own))
            number[short] = 1
        yield first, kept, number


def _seeds(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(salt))
    return base[:n].astype(np.uint32), base[n:].astype(np.uint32) | np.uint32(1)


def minhash(found: np.ndarray, counts: np.ndarray, n: int, salt: int) -> np.ndarray:
    """n MinHash values for each of the non-empty sets that lie one after the other in ``found``."""
    folded = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), n), np.uint32)
    shifts, factors = _seeds(n, salt)
    for k in range(n):
        x = (folded ^ shifts[k]) * factors[k]
        x ^= x >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def _normal(text: str | None) -> bytes:
    return b" ".join(utf8(text.lower()).split()) if text else b""


def _node(normal: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(normal, digest_size=8).digest(), "little", signed=True)


def signatures(docs: DataFrame, rules: JaccardRules) -> DataFrame:
    """doc_id, node (hash of the normal text, null without words) and the keys of its buckets."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for whole in batches:
            for at in range(0, len(whole), 500):  # normal texts and windows are held for a few rows at a time
                yield signed(whole.iloc[at:at + 500])

    def signed(batch: pd.DataFrame) -> pd.DataFrame:
        normal = [_normal(t) for t in batch["text"]]
        keys: list = [None] * len(normal)
        for first, found, counts in _sets(normal, rules):
            full = np.flatnonzero(counts)
            if not len(full):
                continue
            values = minhash(found, counts[full], rules.bands * rules.rows, 0x5851F42D4C957F2D).astype(np.uint64)
            for band in range(rules.bands):
                part = values[:, band * rules.rows:(band + 1) * rules.rows]
                key = np.full(len(full), band + 1, np.uint64)
                for column in part.T:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
                values[:, band] = key  # this band's values are not needed any more
            for i, row in zip(full, values[:, :rules.bands].astype(np.int64)):
                keys[first + i] = row
        nodes = pd.array([_node(t) if t else None for t in normal], "Int64")
        return pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "node": nodes, "keys": keys})

    # ids travel as text: pandas would turn numbers beside a missing one into floats
    kept = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    return kept.mapInPandas(run, "doc_id string, node long, keys array<long>").withColumn("doc_id", F.col("doc_id").cast("long"))


def _verified(a: list[np.ndarray], b: list[np.ndarray], alive: np.ndarray, rules: JaccardRules) -> np.ndarray:
    """Which of the pairs marked in ``alive`` reach the similarity, counted exactly."""
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    if alive.sum() <= 4 * (len(a) + len(b)):
        out = np.zeros(alive.shape, bool)
        for i, j in zip(*np.nonzero(alive)):
            common = len(np.intersect1d(a[i], b[j], assume_unique=True))
            out[i, j] = common >= rules.similarity * (size_a[i] + size_b[j] - common) - 1e-9
        return out
    # many pairs: windows that stand in one set only cannot be common; the others become columns
    every, second = (a, 0) if a is b else (a + b, len(a))
    both = np.concatenate(every)
    _, column, times = np.unique(both, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    rows = np.repeat(np.arange(len(every)), [len(x) for x in every])[shared]
    columns = number[column[shared]]
    common = np.zeros(alive.shape, np.float32)
    width = 2048
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for start in range(0, int(columns[-1]) + 1 if len(columns) else 0, width):
        lo, hi = np.searchsorted(columns, (start, start + width))
        part = np.zeros((len(every), width), np.float32)
        part[rows[lo:hi], columns[lo:hi] - start] = 1
        common += part[:len(a)] @ part[second:].T
    union = size_a[:, None] + size_b[None, :] - common
    return alive & (common >= rules.similarity * union - 1e-9)


def linked(a: list[np.ndarray], b: list[np.ndarray], sig_a: np.ndarray, sig_b: np.ndarray, rules: JaccardRules) -> np.ndarray:
    """Matrix of the linked pairs of two lists of sets, by pruning and verifying."""
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    alive = np.minimum.outer(size_a, size_b) >= rules.similarity * np.maximum.outer(size_a, size_b) - 1e-9
    equal = np.zeros(alive.shape, np.uint8)
    at = 0
    for n, least in rules.needed():
        if not alive.any():
            break
        for k in range(at, n):
            equal += sig_a[:, k, None] == sig_b[None, :, k]
        at = n
        alive &= equal >= least
    return _verified(a, b, alive, rules) if alive.any() else alive


def _least_reached(links: np.ndarray, nodes_a: np.ndarray, nodes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node of both sides the least node that it is connected to over the links."""
    low_a, low_b = nodes_a.copy(), nodes_b.copy()
    far = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(low_a, np.where(links, low_b[None, :], far).min(axis=1))
        new_b = np.minimum(low_b, np.where(links, new_a[:, None], far).min(axis=0))
        if (new_a == low_a).all() and (new_b == low_b).all():
            return low_a, low_b
        low_a, low_b = new_a, new_b


def _compare(rules: JaccardRules):
    names = ["node", "links", "low"]

    def judge(rows: list[tuple]) -> pd.DataFrame | None:
        """rows: (node, copies, left, windows) of one pair of blocks; left is None within one block."""
        seen: dict[tuple, tuple] = {(r[0], r[2]): r for r in rows}
        sides = [[r for r in seen.values() if r[2] is None or r[2] == side] for side in (True, False)]
        if not sides[0] or not sides[1]:
            return None
        within = sides[0][0][2] is None
        sets = [[np.frombuffer(r[3], np.uint64) for r in side] for side in sides]
        signed = [minhash(np.concatenate(s), np.array([len(x) for x in s]), rules.compared, 0x2545F4914F6CDD1D).astype(np.uint16)
                  for s in sets]
        if within:
            sets[1] = sets[0]
        links = linked(*sets, *signed, rules)
        if within:
            np.fill_diagonal(links, False)
        nodes = [np.array([r[0] for r in side], np.int64) for side in sides]
        copies = [np.array([r[1] for r in side], np.int64) for side in sides]
        low = _least_reached(links, *nodes)
        out = [(nodes[0], (links * copies[1][None, :]).sum(axis=1), low[0])]
        if not within:
            out.append((nodes[1], (links * copies[0][:, None]).sum(axis=0), low[1]))
        found = pd.concat([pd.DataFrame(dict(zip(names, o))) for o in out])
        return found[found["links"] > 0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, ready, size = None, [], [], 0
        for batch in batches:
            for root, i, j, left, node, copies, found in batch.itertuples(index=False, name=None):
                if (root, i, j) != key:
                    if len(rows) > 1 and (got := judge(rows)) is not None and len(got):
                        ready.append(got)
                        size += len(got)
                    key, rows = (root, i, j), []
                    if size > 20_000:
                        yield pd.concat(ready)
                        ready, size = [], 0
                rows.append((node, copies, None if i == j else bool(left), found))
        if len(rows) > 1 and (got := judge(rows)) is not None and len(got):
            ready.append(got)
        if ready:
            yield pd.concat(ready)

    return run


def _windows_of(rules: JaccardRules):
    """Adds the sorted windows of a text as bytes; rows whose text is not their node's go."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.iloc[at:at + 500].copy()
                normal = [_normal(t) for t in batch.pop("text")]
                own = np.array([_node(t) for t in normal], np.int64) == batch["node"].to_numpy()
                found: list = [b""] * len(normal)
                for first, all_windows, counts in _sets(normal, rules):
                    ends = np.cumsum(counts)
                    for i, (n, end) in enumerate(zip(counts, ends)):
                        found[first + i] = np.unique(all_windows[end - n:end]).tobytes()
                batch["windows"] = found
                yield batch[own]
    return run


def node_of(text: Column) -> Column:
    """The hash of the normal text that stands for all copies of it; null without words."""
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_node(n) if (n := _normal(t)) else None for t in texts], dtype="Int64")

    return run(text.cast("string"))


def near_classes(docs: DataFrame, rules: JaccardRules = JaccardRules(), with_node: bool = False) -> DataFrame:
    """doc_id, class_id and n_links for each row of ``docs`` (doc_id, text), on request also its ``node``."""
    signed = materialize(signatures(docs, rules), "signatures")
    texts = signed.where("node IS NOT NULL AND doc_id IS NOT NULL")
    nodes = texts.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    placed = texts.select("node", F.explode("keys").alias("key"))
    buckets = placed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    met = placed.join(buckets.select("key", "low"), "key").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    groups = components(met)
    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / rules.block).cast("int").alias("blocks"))
    members = members.join(sizes, "root").join(nodes, "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    candidates = members.select("root", "node", "copies", "blocks", own.alias("own"), F.col("first").alias("doc_id"))
    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with_text = kept.join(candidates, "doc_id").drop("doc_id")
    found = with_text.mapInPandas(
        _windows_of(rules), "root long, node long, copies long, blocks int, own int, windows binary")
    pairs = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") <= F.col("other")).alias("left"), "node", "copies", "windows")
    compared = materialize(
        pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
        .mapInPandas(_compare(rules), "node long, links long, low long"), "links")
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(compared.select(F.col("node").alias("a"), F.col("low").alias("b")))
    roots = joined.join(nodes, "node").groupBy("root").agg(F.min("first").alias("least"))
    roots = roots.join(nodes.select(F.col("node").alias("root"), "first"), "root").select("root", F.least("least", "first").alias("class"))
    classes = joined.join(roots, "root").select("node", "class").unionByName(roots.select(F.col("root").alias("node"), "class"))
    known = nodes.join(links, "node", "left").join(classes, "node", "left").select(
        "node", F.coalesce("class", "first").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    known = materialize(known, "classes")  # so that the join below is a plain one, which adaptive execution can split
    return signed.select("doc_id", "node").join(known, "node", "left").select(
        *(["node"] if with_node else []), "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"))
