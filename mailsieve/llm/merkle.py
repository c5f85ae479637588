"""Merkle manifest of a table by time-forward processing.

Every row is a leaf. The leaves of a language, ascending by doc_id, make a tree of ``ARITY`` children a node; the roots
of the languages, ordered by language, make the tree on top. A node's label is (last leaf below it, level), so children
come before their parents in label order. The forward sweep visits labels in ascending order: a priority queue holds
the messages (parent's label, digest) of nodes already visited and hands a node all its children's digests when its
label is least. Then a reversed sweep hands every node the rest of its proof, the siblings of all nodes above it, and
so each leaf its whole proof.

Outside a task the queue is Spark's sorted shuffle: a tree is cut into runs of ``ARITY ** LEVELS`` nodes of one level,
one sweep covers a run, and its message goes to the run above, which the next round handles. The number of rounds is
the logarithm of the number of leaves to a base of 4,096; a run has at most 4,096 narrow rows, whatever the size of a
language. The reversed rounds take the suffix of a run's top from the round above.

Missing values are written as ``-`` and so differ from empty ones. Missing doc_ids come first and count as '' where the
number of a row matters; rows that share a doc_id are leaves for themselves, ordered by their digests; a missing
language is a language and comes first. Texts of any length enter whole, in the JVM. An empty table has no root and
gives no rows. Columns other than doc_id, source, lang, n_chars and text are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.positions import beside, range_offsets, sorted_rows, with_offsets
from mailsieve.plans.session import materialize

ARITY = 8
LEVELS = 4
RUN = ARITY ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: number of the tree whose leaves are the roots of the languages; those are numbered from 0
TOP = -1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(values: Sequence[Column]) -> Column:
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def every_third(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 0


# one run of nodes, first to last, inside a task

class Node:
    """An inner node with its children, by position, and their labels."""

    __slots__ = ("label", "children")

    def __init__(self, label: tuple[int, int], children: list[tuple[tuple[int, int], str]]):
        self.label, self.children = label, children


def sweep(leaves: Sequence[str], whole: bool) -> tuple[str, list[Node]]:
    """The digest on top of a run and its inner nodes in label order. A run that is the ``whole`` tree ends with the
    first single node; any other goes up ``LEVELS`` levels, also where a node has one child only."""
    count, height = len(leaves), 0
    if whole:
        while count > ARITY ** height:
            height += 1
    else:
        height = LEVELS
    queue: list[tuple] = []
    nodes: list[Node] = []
    top = leaves[0]

    def send(number: int, level: int, found: str) -> None:
        nonlocal top
        if level == height:
            top = found
            return
        span = ARITY ** (level + 1)
        parent = number // ARITY
        label = (min((parent + 1) * span, count) - 1, level + 1)
        heapq.heappush(queue, (label, number, found))

    def deliver(before: tuple[int, int]) -> None:
        while queue and queue[0][0] < before:
            label = queue[0][0]
            children, number = [], 0
            while queue and queue[0][0] == label:
                _, number, found = heapq.heappop(queue)
                last = min((number + 1) * ARITY ** (label[1] - 1), count) - 1
                children.append(((last, label[1] - 1), found))
            nodes.append(Node(label, children))
            send(number // ARITY, label[1], digest("".join(c for _, c in children)))

    for number, leaf in enumerate(leaves):
        send(number, 0, leaf)
        deliver((number + 1, 0))
    return top, nodes


def sweep_back(leaves: Sequence[str], whole: bool, suffix: Sequence[str]) -> list[list[str]]:
    """The proof of every leaf of a run: left and right siblings of each level, then ``suffix``, that of the run's top."""
    _, nodes = sweep(leaves, whole)
    if not nodes:
        return [list(suffix)]
    known = {nodes[-1].label: list(suffix)}
    for node in reversed(nodes):
        above = known.pop(node.label)
        for k, (label, _) in enumerate(node.children):
            left = "".join(d for _, d in node.children[:k])
            right = "".join(d for _, d in node.children[k + 1:])
            known[label] = [left, right, *above]
    return [known[number, 0] for number in range(len(leaves))]


def fold(leaf: str, proof: Sequence[str]) -> str:
    for left, right in zip(proof[::2], proof[1::2]):
        leaf = digest(left + leaf + right)
    return leaf


# all runs of one level of all trees

_NODES = "tree long, idx long, digest string, n long"
_SUFFIXES = "tree long, idx long, suffix array<string>, subroot string, root string"


def _up(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("idx")
    n = int(rows["n"].iloc[0])
    top, _ = sweep(rows["digest"].tolist(), n <= RUN)
    return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "digest": [top], "n": [-(-n // RUN)]})


def _in_runs(nodes: DataFrame):
    return nodes.withColumn("run", F.floor(F.col("idx") / F.lit(RUN))).groupBy("tree", "run")


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The node tables of all rounds, the given one first, and the roots of the trees."""
    rounds, roots = [], None
    while True:
        rounds.append(nodes)
        tops = materialize(_in_runs(nodes.select("tree", "idx", "digest", "n")).applyInPandas(_up, _NODES), "nodes")
        done = tops.where("n = 1")
        roots = done if roots is None else roots.unionByName(done)
        nodes = tops.where("n > 1")
        if nodes.isEmpty():
            return rounds, roots


def _descend(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Suffixes of ``nodes`` from those of the runs above them."""
    def run(rows: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        rows, top = rows.sort_values("idx"), top.iloc[0]
        found = sweep_back(rows["digest"].tolist(), int(rows["n"].iloc[0]) <= RUN, list(top["suffix"]))
        return pd.DataFrame({"tree": rows["tree"], "idx": rows["idx"], "suffix": found, "subroot": top["subroot"], "root": top["root"]})

    given = above.withColumnRenamed("idx", "run").groupBy("tree", "run")
    return _in_runs(nodes.select("tree", "idx", "digest", "n")).cogroup(given).applyInPandas(run, _SUFFIXES)


def _proved(leaves: DataFrame, above: DataFrame) -> DataFrame:
    """The last reversed round: leaves fold their proofs."""
    def run(rows: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        rows, top = rows.sort_values("idx"), top.iloc[0]
        suffix, root = list(top["suffix"]), top["root"]
        proofs = sweep_back(rows["digest"].tolist(), int(rows["n"].iloc[0]) <= RUN, suffix)
        folded = [fold(given, proof) for given, proof in zip(rows["tampered"], proofs)]
        return pd.DataFrame({
            "doc_id": rows["doc_id"], "leaf": rows["digest"], "subroot": top["subroot"], "root": root,
            "proof_sha256": [digest("".join(proof)) for proof in proofs], "folded_root": folded,
            "verified": [f == root for f in folded]})

    given = above.withColumnRenamed("idx", "run").groupBy("tree", "run")
    return _in_runs(leaves).cogroup(given).applyInPandas(
        run, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _numbered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves by tree and index, and the trees by number and language."""
    table = sorted_rows(leaves, ["lang", "number", "digest"], "leaves")
    offsets = range_offsets(table, ["lang"])
    langs = sorted_rows(offsets.select("lang", F.col("_size").alias("n")).distinct(), ["lang"], "langs")
    langs = with_offsets(langs, range_offsets(langs, []), []).select("lang", "n", F.col("position").alias("tree"))
    langs = materialize(langs, "langs")
    placed = with_offsets(table, beside(offsets, langs, ["lang"]), ["lang"]).select(
        "tree", F.col("position").alias("idx"), "digest", "n", "doc_id", "tampered")
    return materialize(placed, "placed"), langs


def manifest(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, one row for each row of ``docs``.
    Where ``tamper`` holds, the leaf is folded as it would be with the text's A-Z in lower case."""
    fields = [F.col(c) for c in FIELDS]
    leaf = leaf_digest(fields)
    other = leaf if tamper is None else F.when(tamper, leaf_digest([*fields[:-1], lower_ascii(F.col("text").cast("string"))])).otherwise(leaf)
    # doc_id is text in the tasks: pandas would turn numbers beside a missing one into floats
    kind = docs.schema["doc_id"].dataType
    leaves = docs.select("lang", F.col("doc_id").alias("number"), F.col("doc_id").cast("string").alias("doc_id"),
                         leaf.alias("digest"), other.alias("tampered"))
    placed, langs = _numbered(leaves)
    rounds, subroots = _climb(placed)
    subroots = materialize(subroots.select("tree", "digest"), "subroots")
    tops = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest").crossJoin(langs.agg(F.count("*").alias("n")))
    top_rounds, root = _climb(tops)

    above = root.select("tree", "idx", F.array().cast("array<string>").alias("suffix"), F.lit(None).cast("string").alias("subroot"),
                        F.col("digest").alias("root"))
    for nodes in reversed(top_rounds):
        above = materialize(_descend(nodes, above), "suffixes")
    by_tree = above.select(F.col("idx").alias("tree"), "suffix", "root").join(subroots.withColumnRenamed("digest", "subroot"), "tree")
    first = materialize(by_tree.select("tree", F.lit(0).cast("long").alias("idx"), "suffix", "subroot", "root"), "suffixes")
    # a tree enters in the round that reached its root, from there down it has suffixes of its own
    above = first.limit(0)
    for nodes in reversed(rounds[1:]):
        entering = first.join(nodes.select("tree").distinct(), "tree", "left_semi").join(above.select("tree").distinct(), "tree", "left_anti")
        above = materialize(_descend(nodes, above.unionByName(entering)), "suffixes")
    above = above.unionByName(first.join(above.select("tree").distinct(), "tree", "left_anti"))
    return _proved(placed, above).withColumn("doc_id", F.col("doc_id").cast(kind))
