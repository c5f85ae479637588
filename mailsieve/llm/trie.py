"""The prefix trie of rebuilt conversations, from composable fingerprints.

Conversations are stored as a shared head and an own suffix: conversation c is rebuilt as the first h turns of its base
conversation and its own turns after the first h. The fingerprint of a sequence of turns is the product of affine maps
x -> B x + t modulo 2^127 - 1, one for each turn, applied to 0. Products are a monoid, and the maps have inverses: from
the prefix products of the conversations as they are stored, the product of every rebuilt prefix follows by
arithmetic, (head - own head) B^k + own prefix. No rebuilt text is ever made, and no text leaves the first scan.

A node is a depth and a fingerprint. Each of its members refers to the stored turn that ends its prefix, by that turn's
SHA-256 digest; a node is right if all its members refer to equal turns, because the products of their parents are then
equal as well, up to the root. Should a fingerprint ever join different turns, all is computed again with another B.

The smallest member of a node owns it. The nodes that a conversation owns are the deepest ones of its path, so one
number for each conversation, the depth from which it owns, says for every node below a prefix in whose row it is
counted: subtree totals are plain sums over members, without a walk through the levels.

Null role or text: empty. Rows without conv_id belong to no conversation and take no part. Turns are ordered by turn,
null first, rows with equal turns by the digest of role and text; repeated rows are turns like others. Texts of any
length are digested whole, in the JVM. Empty table: no nodes. Columns other than these four are not looked at.

No conversation, node or parent is one group of one task: conversations are numbered by ranges of their turns, rows
meet the values of their conversation by (conversation, range), nodes are sums that combine before the shuffle, and
parents with more than a thousandth of all nodes, fewer than a thousand of them, are broadcast. The digest of all ids
that end in a node is sequential by definition; ids are sorted and joined by ranges, and one task streams the pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.llm.positions import sorted_rows
from mailsieve.plans.session import materialize

P = (1 << 127) - 1
#: depths that one copy of a conversation's values serves
STRETCH = 10_000
#: range of the ids that are joined in one piece
PIECE = 8_192
_EMPTY = hashlib.sha256(b"").hexdigest()


class Collision(Exception):
    """Different turns met in one fingerprint."""


def base_of(seed: int) -> int:
    return int.from_bytes(hashlib.sha256(f"trie {seed}".encode()).digest(), "big") % (P - 3) + 2


def turn_value(digest: str) -> int:
    return int(digest[:31], 16) + 1


def shown(x: int) -> str:
    return f"{x:032x}"


def head_length(conv_id: Column, at_most: int) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string")), F.lit(at_most + 1)).cast("int")


def _prefix_products(base: int) -> Callable:
    """Rows of sorted turns -> number, product and characters of the prefix that ends with each, within its range."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, n, product, chars = None, 0, 0, 0
        for batch in batches:
            numbers, products, totals = [], [], []
            for c, d, k in zip(batch["conv_id"].tolist(), batch["digest"].tolist(), batch["chars"].tolist()):
                if c != conv:
                    conv, n, product, chars = c, 0, 0, 0
                n, product, chars = n + 1, (product * base + turn_value(d)) % P, chars + k
                numbers.append(n)
                products.append(shown(product))
                totals.append(chars)
            yield batch[["conv_id", "digest", "chars", "_part"]].assign(n=numbers, product=products, total=totals)

    return run


_TURNS = "conv_id long, digest string, chars long, _part long, n long, product string, total long"
_EARLY = "array<struct<place: long, digest: string, chars: long, total: long, print: string>>"
_RANGES = f"conv_id long, _part long, n_turns long, n0 long, product0 string, total0 long, early {_EARLY}"


def _ranges(turns: DataFrame, at_most: int, base: int) -> DataFrame:
    """For each conversation and range: the turns, product and characters of the ranges before it, and those of its
    turns that may be among the conversation's first ``at_most``, with the prefix product of the conversation."""
    early = F.struct(F.col("n").alias("place"), "digest", "chars", "total", F.col("product").alias("print"))
    ranges = turns.groupBy("conv_id", "_part").agg(
        F.max(F.struct("n", "product", "total")).alias("e"), F.sort_array(F.collect_list(F.when(F.col("n") <= at_most, early))).alias("early"))
    whole = Window.partitionBy("conv_id")
    ranges = ranges.select("conv_id", "_part", "e.*", "early", F.sum("e.n").over(whole).alias("n_turns"), F.count("*").over(whole).alias("k"))
    ranges = materialize(ranges, "ranges")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if not rows:
            return
        for _, of_conv in pd.concat(rows).sort_values(["conv_id", "_part"]).groupby("conv_id", sort=False):
            n = product = total = 0
            out = []
            for row in of_conv.itertuples(index=False):
                moved = [{**t, "place": n + t["place"], "total": total + t["total"],
                          "print": shown((product * pow(base, int(t["place"]), P) + int(t["print"], 16)) % P)} for t in row.early]
                out.append((row.conv_id, row._1, row.n_turns, n, shown(product), total, moved))
                n, product, total = n + row.n, (product * pow(base, row.n, P) + int(row.product, 16)) % P, total + row.total
            yield pd.DataFrame(out, columns=["conv_id", "_part", "n_turns", "n0", "product0", "total0", "early"])

    plain = ranges.where("k = 1").selectExpr(
        "conv_id", "_part", "n_turns", "0L AS n0", f"'{shown(0)}' AS product0", "0L AS total0", "early")
    # a range has at most two conversations that go on in another one, so these are at most two rows a range
    return plain.unionByName(ranges.where("k > 1").drop("k").repartition(1).mapInPandas(run, _RANGES))


def _composed(base: int) -> Callable:
    """Rows of own turns -> fingerprints of the rebuilt prefix and of the one before: the base's head in the place of the
    own head, then the ranges before, then the prefix within the range."""
    inverse = pow(base, -1, P)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, parents = [], []
            last, known = None, 0
            for head, own, product0, k, n, product, d in zip(*(batch[c].tolist() for c in ("head", "own", "product0", "k", "n", "product", "digest"))):
                if last != (head, own, product0, k):
                    last = head, own, product0, k
                    known = ((int(head, 16) - int(own, 16)) * pow(base, k, P) + int(product0, 16)) % P
                here = (known * pow(base, n, P) + int(product, 16)) % P
                found.append(shown(here))
                parents.append(shown((here - turn_value(d)) * inverse % P))
            yield batch[["conv_id", "depth", "digest", "chars", "total", "length"]].assign(print=found, parent=parents)

    return run


_PREFIXES = "conv_id long, depth long, digest string, chars long, total long, length long, print string, parent string"


def prefixes(conversations: DataFrame, group: int, at_most: int, base: int) -> DataFrame:
    """One row for each rebuilt conversation and depth from 0 to its ``length``: the fingerprints ``print`` and
    ``parent``, the digest and characters of the last turn, and the characters so far (``total``)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", named.alias("digest"), F.length(text).cast("long").alias("chars"))
    turns = sorted_rows(rows, ["conv_id", "turn", "digest"], "turns",
                        lambda s: s.select("conv_id", "digest", "chars", "_part").mapInPandas(_prefix_products(base), _TURNS))
    ranges = _ranges(turns, at_most, base)

    early = ranges.where(F.col("n0") < at_most).select("conv_id", "n_turns", F.explode("early").alias("turn")).where(F.col("turn.place") <= at_most)
    heads = early.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.sort_array(F.collect_list("turn")).alias("turns"))
    own = heads.withColumns({"h": head_length(F.col("conv_id"), at_most), "base_id": F.col("conv_id") - F.pmod("conv_id", F.lit(group))})
    bases = heads.select(F.col("conv_id").alias("base_id"), F.col("turns").alias("base_turns"))
    own = own.join(bases, "base_id", "left").withColumn("base_turns", F.coalesce("base_turns", F.array().cast(_EARLY)))
    own = own.withColumn("kept", F.least(F.col("h"), F.size("base_turns")))

    def at(array: str, place: Column, field: str, otherwise: Column) -> Column:
        return F.coalesce(F.get(F.col(array), place - 1)[field], otherwise)

    zero = F.lit(shown(0))
    own = own.withColumns({
        "head": at("base_turns", F.col("kept"), "print", zero), "own": at("turns", F.col("h"), "print", zero),
        "rise": (F.col("kept") - F.col("h")).cast("long"),
        "chars0": at("base_turns", F.col("kept"), "total", F.lit(0)) - at("turns", F.col("h"), "total", F.lit(0)),
        "length": F.col("kept") + F.greatest(F.lit(0), F.col("n_turns") - F.col("h"))})
    own = materialize(own.select("conv_id", "h", "kept", "head", "own", "rise", "chars0", "length", "n_turns", "base_turns"), "rebuilt")

    taken = own.select("conv_id", "length", "base_turns", F.explode(F.slice("base_turns", F.lit(1), F.col("kept"))).alias("t"))
    shared = taken.select("conv_id", F.col("t.place").alias("depth"), "t.digest", "t.chars", "t.total", "length", "t.print",
                          at("base_turns", F.col("t.place").cast("int") - 1, "print", zero).alias("parent"))
    roots = own.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("chars"),
                       F.lit(0).cast("long").alias("total"), "length", zero.alias("print"), F.lit("").alias("parent"))
    values = own.where("n_turns > h").select("conv_id", "h", "head", "own", "rise", "chars0", "length").join(ranges.drop("n_turns", "early"), "conv_id")
    rest = turns.join(values, ["conv_id", "_part"]).where("n0 + n > h").selectExpr(
        "conv_id", "n0 + n + rise AS depth", "digest", "chars", "chars0 + total0 + total AS total", "length", "head", "own", "product0",
        "n0 - h AS k", "n", "product")
    return roots.unionByName(shared).unionByName(rest.mapInPandas(_composed(base), _PREFIXES))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted pieces -> one digest for each node."""
    node, state = None, None
    for batch in batches:
        done = []
        for depth, mark, ids in zip(batch["depth"].tolist(), batch["print"].tolist(), batch["ids"].tolist()):
            if (depth, mark) == node:
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((*node, state.hexdigest()))
            node, state = (depth, mark), hashlib.sha256(ids.encode())
        yield pd.DataFrame(done, columns=["depth", "print", "ends_sha256"]).astype({"depth": np.int64})
    if node is not None:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["depth", "print", "ends_sha256"])


def end_digests(rows: DataFrame) -> DataFrame:
    """depth, print, ends_sha256 of the nodes in which a conversation ends."""
    ends = rows.where("depth = length").withColumn("bucket", F.floor(F.col("conv_id") / F.lit(PIECE)))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("depth", "print", "bucket").agg(ids.alias("ids"))  # a bucket has at most PIECE different ids
    pieces = pieces.repartition("depth", "print").sortWithinPartitions("depth", "print", "bucket")
    return pieces.select("depth", "print", "ids").mapInPandas(_digests, "depth long, print string, ends_sha256 string")


def _stretched(values: DataFrame) -> DataFrame:
    return values.withColumn("stretch", F.explode(F.expr(f"sequence(0L, length div {STRETCH})")))


def nodes_of(rows: DataFrame) -> DataFrame:
    """The nodes of ``prefixes``. Raises ``Collision`` if a fingerprint stands for different turns."""
    first = F.min(F.struct("conv_id", "total", "chars")).alias("first")
    owners = rows.groupBy("depth", "print").agg(first, F.max(F.col("length") > F.col("depth")).alias("inner"))
    owned = owners.groupBy(F.col("first.conv_id").alias("conv_id")).agg(
        F.min(F.struct("depth", (F.col("first.total") - F.col("first.chars")).alias("before"))).alias("a"),
        F.max((~F.col("inner")).cast("long")).alias("leaf"))
    # a conversation that owns nothing owns from beyond its end
    ends = rows.where("depth = length").select("conv_id", "length", "total")
    values = ends.join(owned, "conv_id", "left").select(
        "conv_id", "length", F.coalesce("a.depth", F.col("length") + 1).alias("from"),
        F.coalesce("a.before", "total").alias("before"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    values = _stretched(values).withColumnRenamed("length", "_length")
    at = rows.withColumn("stretch", F.expr(f"depth div {STRETCH}")).join(values, ["conv_id", "stretch"])
    child = (F.col("from") <= F.col("depth") + 1) & (F.col("depth") < F.col("length"))
    saved = F.greatest(F.lit(0), F.col("before") - F.col("total") + F.col("chars"))
    found = at.groupBy("depth", "print").agg(
        F.min("conv_id").alias("conv_id"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"),
        F.sum(child.cast("long")).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"),
        F.min("digest").alias("low"), F.max("digest").alias("high"))
    found = materialize(found, "nodes")
    if not found.where("low <> high").isEmpty():
        raise Collision
    return found.drop("low", "high")


def _with_parents(nodes: DataFrame) -> DataFrame:
    n = nodes.count()
    owners = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("print").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
        (F.col("n_children") * 1000 > n).alias("many"))
    # every node but the root is a child, so fewer than a thousand parents have more than a thousandth of all nodes
    few = F.broadcast(owners.where("many").select("depth", "parent", F.col("parent_conv_id").alias("_wide")))
    split = nodes.join(few, ["depth", "parent"], "left")
    wide = split.where("_wide IS NOT NULL").withColumnRenamed("_wide", "parent_conv_id")
    narrow = split.where("_wide IS NULL").drop("_wide").join(owners.where("NOT many").drop("many"), ["depth", "parent"], "left")
    return wide.unionByName(narrow)


def prefix_trie(conversations: DataFrame, group: int = 100, at_most: int = 5, seeds: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row for each node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. Conversation c takes at most ``at_most`` turns of conversation c - c % ``group``."""
    for seed in seeds:
        rows = materialize(prefixes(conversations, group, at_most, base_of(seed)), "prefixes")
        try:
            nodes = nodes_of(rows)
        except Collision:
            continue
        found = _with_parents(nodes).join(end_digests(rows), ["depth", "print"], "left")
        return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                            F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    raise ArithmeticError("fingerprints of different turns met under every seed")
