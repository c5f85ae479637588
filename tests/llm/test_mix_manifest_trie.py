"""Mixing, the Merkle manifest and the conversation trie against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailsieve.llm import merkle, mixing, positions, trie

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def rows_of(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


# positions

def test_positions_and_running_sums_of_hot_and_missing_groups(spark):
    data = [(None if i % 3 else f"g{i % 5}", i * 7 % 101, i) for i in range(500)]
    frame = spark.createDataFrame(data, "g string, o long, v long").repartition(7)
    found = {r.v: (r.position, r.before_v) for r in positions.running(frame, ["g"], ["o", "v"], ["v"], "t").collect()}
    for group in {d[0] for d in data}:
        total = 0
        for k, (_, _, v) in enumerate(sorted((d for d in data if d[0] == group), key=lambda d: d[1:])):
            assert found[v] == (k, total)
            total += v


# mixing

def plain_mix(docs, weights=(5, 2, 1), most=3):
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in docs]
    sources = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    have = {s: sum(n for n, d in zip(sizes, docs) if d[1] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    full: set = set()
    while True:
        left = sum(have.values()) - sum(most * have[s] for s in full)
        open_weight = sum(weight[s] for s in sources if s not in full)
        target = {s: float(most * have[s]) if s in full else left * weight[s] / open_weight for s in sources}
        more = {s for s in sources if s not in full and target[s] > most * have[s]}
        if not more:
            break
        full |= more
    out = []
    for s in sources:
        copies = int(target[s] // have[s]) if have[s] else 0
        lacking = max(0.0, target[s] - copies * have[s])
        rows = []
        for (doc, source, text), n in zip(docs, sizes):
            if source == s:
                key = f"{'' if doc is None else doc}:{text or ''}".encode()
                u = (int(hashlib.md5(key).hexdigest()[:13], 16) + 0.5) / 2 ** 52
                rows.append((u, doc, n))
        rows.sort(key=lambda r: r[0])
        at, chosen, rest = 0, [], []
        for row in rows:
            fits = at + row[2] <= lacking and not any(r[2] for r in rest)
            (chosen if fits else rest).append(row)
            at += row[2] if fits else 0
        near = min(rest, key=lambda r: (abs(lacking - at - r[2]), r[0]), default=None)
        if near is not None and abs(lacking - at - near[2]) < lacking - at:
            rest.remove(near)
            chosen.append(near)
        out += [(d, n, have[s], target[s], n * (copies + 1)) for _, d, n in chosen]
        out += [(d, n, have[s], target[s], n * copies) for _, d, n in rest]
    return out


def messy_docs(n=400):
    rng = random.Random(3)
    docs = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "é", "Z", "", None, "tiny"] if i < 9 else ["a", "b", "é", None])
        docs.append((None if i % 17 == 0 else i // 2, source, None if i % 29 == 0 else " \n".join(["w"] * rng.choice([0, 1, 3, 50, 700])) + str(i % 11)))
    return docs + docs[:20]


def test_mixing_equals_plain_python(spark):
    docs = messy_docs()
    frame = spark.createDataFrame([(d, s, t, 1, 2.0) for d, s, t in docs], "doc_id long, source string, text string, size int, target double")
    columns = ("doc_id", "size", "source_size", "target", "taken")
    for parts in (1, 6):
        found = rows_of(mixing.mix(frame.repartition(parts)), *columns)
        want = sorted(plain_mix(docs), key=repr)
        assert [(r[0], r[1], r[2], r[4]) for r in found] == [(r[0], r[1], r[2], r[4]) for r in want]
        assert [r[3] for r in found] == pytest.approx([r[3] for r in want])


def test_mixing_comes_near_its_targets_and_never_beyond_three_copies(spark):
    docs = messy_docs(3000)
    found = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string"))
    for r in found.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("source_size").alias("s"), F.max("copies").alias("c")).collect():
        assert r.c <= 3 and abs(r.t - r.g) <= 351  # half of the largest document, which has 701 words
    total = found.groupBy("source").agg(F.max("target").alias("g"), F.max("source_size").alias("s")).agg(F.sum("g"), F.sum("s")).first()
    assert total[0] == pytest.approx(total[1])


def test_every_copy_is_equally_likely(spark):
    """Over many ids, documents of every size are repeated at the rate target / source_size."""
    docs = [(i, "a" if i % 2 else "b", "w " * (1 + i % 4)) for i in range(8000)]
    found = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string"))
    rates = found.groupBy("source", "size").agg(F.avg("copies").alias("c"), F.max(F.col("target") / F.col("source_size")).alias("r")).collect()
    assert all(abs(r.c - r.r) < 0.06 for r in rates)


@pytest.mark.parametrize("docs", [[], [(1, None, None)], [(1, "a", ""), (2, "a", " \n")], [(1, "a", "w"), (1, "a", "w")]])
def test_mixing_of_little(spark, docs):
    found = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()
    assert len(found) == len(docs) and all(r.taken == r.size for r in found)


# Merkle manifest

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n_chars, text)))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([sha("".join(at[i:i + 8])) for i in range(0, len(at), 8)])
    return levels


def plain_path(levels, i):
    path = []
    for level in levels[:-1]:
        first = i - i % 8
        path.append(("".join(level[first:i]), "".join(level[i + 1:first + 8])))
        i //= 8
    return path


def plain_manifest(docs):
    by_lang = defaultdict(list)
    for d in docs:
        by_lang[d[2]].append((d[0] is not None, d[0] or 0, plain_leaf(*d), d))
    trees = []
    for lang in sorted(by_lang, key=lambda x: (x is not None, (x or "").encode())):
        leaves = sorted(by_lang[lang], key=lambda x: x[:3])
        trees.append((leaves, plain_levels([x[2] for x in leaves])))
    top = plain_levels([levels[-1][0] for _, levels in trees])
    out = []
    for t, (leaves, levels) in enumerate(trees):
        for i, (_, _, leaf, (doc, source, lang, n, text)) in enumerate(leaves):
            path = plain_path(levels, i) + plain_path(top, t)
            if zlib.crc32(b"" if doc is None else str(doc).encode()) % 3 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
            at = plain_leaf(doc, source, lang, n, text)
            for left, right in path:
                at = sha(left + at + right)
            out.append((doc, leaf, levels[-1][0], top[-1][0], sha("".join(a + b for a, b in path)), at, at == top[-1][0]))
    return out


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_equals_plain_python(spark):
    rng = random.Random(5)
    docs = [(i, "s", "hot", i, f"Text {i} É") for i in range(4700)]  # more than one run of 4,096
    langs = [None, "", "a", "B", "é", "zz", "one", "x1", "x2", "x3"]
    docs += [(rng.choice([None, 5, i]), rng.choice([None, "S"]), rng.choice(langs), rng.choice([None, 0]), rng.choice([None, "", "no", "YES"])) for i in range(300)]
    docs += docs[-30:] + [(7, "s", "alone", 1, "A" * 100_000)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS + ", leaf int, _part string")
    found = merkle.manifest(frame.repartition(5), merkle.every_third(F.col("doc_id")))
    assert rows_of(found, *MANIFEST) == sorted(plain_manifest(docs), key=repr)


@pytest.mark.parametrize("docs", [[], [(None, None, None, None, None)], [(1, "s", "en", 1, "A")] * 2])
def test_manifest_of_little(spark, docs):
    found = merkle.manifest(spark.createDataFrame(docs, DOCS), merkle.every_third(F.col("doc_id")))
    assert rows_of(found, *MANIFEST) == sorted(plain_manifest(docs), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 700))
def test_sweeps_of_any_length(n):
    leaves = [sha(str(i)) for i in range(n)]
    levels = plain_levels(leaves)
    top, nodes = merkle.sweep(leaves, True)
    assert top == levels[-1][0] and len(nodes) == sum(map(len, levels[1:]))
    assert [node.label for node in nodes] == sorted(node.label for node in nodes)
    proofs = merkle.sweep_back(leaves, True, ["l", "r"])
    for i in (0, n // 2, n - 1):
        path = [x for pair in plain_path(levels, i) for x in pair]
        assert proofs[i] == [*path, "l", "r"]
        assert merkle.fold(leaves[i], path) == top


# conversation trie

def plain_trie(rows):
    stored = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = sha(f"{len(role.encode())}:{role}{text}")
            stored[conv].append((turn is not None, turn or 0, mark, role, text))
    turns = {c: [t[3:] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in stored.items()}
    made = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = turns.get(c - c % 100, [])[:h] + turns[c][h:]
    members = defaultdict(set)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].add(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or (not children[node])
        saved[node] = sum(saved[c] for c in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    out = []
    for node, inside in members.items():
        ends = ",".join(map(str, sorted(c for c in inside if len(made[c]) == len(node))))
        out.append((min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), len(children[node]),
                    int(leaves[node]), saved[node], sha(ends)))
    return out


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
CHAT = "conv_id long, turn int, role string, text string"


def test_trie_equals_plain_python(spark):
    rng = random.Random(9)
    rows = []
    for c in [*range(0, 60), *range(100, 180), *range(205, 260)]:  # conversation 200 is absent
        for turn in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, None if turn == 0 and c % 7 == 0 else turn, rng.choice(["user", "assistant", None]), rng.choice([None, "", "hi", "é" * 3, "yes"])))
    rows += [(c, t, "user", "same") for c in range(300, 330) for t in range(4)]
    rows += rows[:40] + [(None, 1, "user", "lost")] + [(5, 3, "user", "tie"), (5, 3, "user", "tied")]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], CHAT + ", depth int, print string")
    found = trie.prefix_trie(frame.repartition(5))
    assert rows_of(found, *TRIE) == sorted(plain_trie(rows), key=repr)


def test_trie_with_one_long_conversation_and_many_equal_ones(spark, monkeypatch):
    """A conversation over many ranges, more equal ones than ids in a piece, parents with many and with few children."""
    monkeypatch.setattr(trie, "STRETCH", 7)
    rows = [(100, t, "user", f"t{t}") for t in range(3000)]
    rows += [(c, 0, "user", "same") for c in range(1000, 1000 + trie.PIECE + 500)]
    rows += [(c, t, "user", f"{c % 50} {t}") for c in range(20_000, 20_120) for t in range(8)]
    found = trie.prefix_trie(spark.createDataFrame(rows, CHAT).repartition(9))
    assert rows_of(found, *TRIE) == sorted(plain_trie(rows), key=repr)


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "a")], [(103, 0, "user", "a")], [(1, None, None, None)] * 3, [(0, 0, "u", "w" * 300_000)]])
def test_trie_of_little(spark, rows):
    assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, CHAT)), *TRIE) == sorted(plain_trie(rows), key=repr)


def test_a_collision_is_noticed(spark):
    rows = spark.createDataFrame(
        [(1, 1, "d1", 1, 1, 1, "same", "00"), (2, 1, "d2", 1, 1, 1, "same", "00")], trie._PREFIXES)
    with pytest.raises(trie.Collision):
        trie.nodes_of(rows)
