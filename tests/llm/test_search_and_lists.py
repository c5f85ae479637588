"""Top-k search, URL lists, chat formatting."""

import datetime as dt
import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mailsieve.llm import chat, topk, url_lists

VECTORS = "vec_id long, embedding array<double>, shard string"


def brute(rows, k):
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in whole:
        if q is None or q % 20:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows, **kw):
    table = spark.createDataFrame(rows, VECTORS)
    return sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 20 == 0, **kw).collect()))


def test_top_k_equals_brute_force_over_small_shards(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.normal(0, 0.2, 12) * (1 if i % 7 else 4)).tolist(), "x") for i in range(900)]
    rows += [(1000 + i, rows[20][1], "copy") for i in range(200)]  # one very common vector: ties everywhere
    assert found(spark, rows, k=20, shard_rows=150, block_rows=16) == brute(rows, 20)


@pytest.mark.parametrize("strip", [16, 64])
def test_top_k_with_pruned_terms_equals_brute_force(spark, strip):
    """Many strips a shard, and few wide terms: most terms become non-essential."""
    rng = np.random.default_rng(7)
    rows = [(int(i), (rng.normal(0, 1, 12) * ([3, 2, 1] + [0.05] * 9)).tolist(), "x") for i in range(1200)]
    rows += [(2000 + i, rows[40][1], "copy") for i in range(100)]
    assert found(spark, rows, k=5, shard_rows=500, block_rows=30, strip=strip) == brute(rows, 5)


@pytest.mark.parametrize("room, most", [(0.1, 0.95), (1.0, 0.5)])
def test_pruning_skips_terms_and_keeps_the_best(room, most):
    rng = np.random.default_rng(3)
    scale = np.array([40, 30, 20] + [2] * 20)
    vectors = np.floor(rng.normal(0, 1, (2000, 23)) * scale).astype(np.int64)
    ids, queries = np.arange(2000), vectors[::20]
    work, plain = [], topk._traverse
    try:
        topk._traverse = lambda q, essential, part: work.append(essential.sum() / essential.size) or plain(q, essential, part)
        got_ids, got = topk.search_shard(queries, ids[::20], vectors.T.copy(), ids, 10, strip=64, room=room)
    finally:
        topk._traverse = plain
    assert work[-1] < most
    for i, q in enumerate(queries):
        want = sorted((-int(q @ v), j) for j, v in enumerate(vectors) if j != 20 * i)[:10]
        assert [(-int(s), int(j)) for s, j in zip(got[i], got_ids[i])] == want


def test_top_k_edges(spark):
    rows = [(0, [0.5, -0.5], "a"), (1, None, "a"), (2, [0.1, None], "a"), (3, [float("nan"), 1.0], "a"), (4, [float("inf"), 1.0], "a"),
            (5, [1.0], "short"), (6, [0.5, -0.5], "a"), (20, [0.5, -0.5], "a")]
    assert found(spark, rows, k=20) == brute([(i, (v + [0.0] if v == [1.0] else v)) for i, v, _ in rows], 20)
    assert found(spark, [(0, [1.0], "only")], k=5) == [] and found(spark, [], k=5) == []
    big = [(0, [float(2 ** 20)], "a"), (1, [float(2 ** 20)], "a"), (2, [-1.0], "a")]
    assert found(spark, big, k=2) == [(0, 1, 1, 2 ** 52), (0, 2, 2, -(2 ** 32))]
    assert len(found(spark, [(0, [1.0], "q"), (0, [1.0], "q"), (1, [1.0], "c")], k=5)) == 2  # the query row twice


def test_top_k_of_many_cells_broadcasts_nothing(spark):
    """Each query block was joined with every shard, and Spark sent those copies through the driver."""
    rng = np.random.default_rng(11)
    rows = [(int(i), rng.normal(0, 0.3, 6).tolist(), "x") for i in range(700)]
    table = spark.createDataFrame(rows, VECTORS)
    out = topk.top_k(table, F.col("vec_id") % 20 == 0, k=3, shard_rows=64, block_rows=8, strip=32)
    plan = out._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "collect_list" not in plan and "Join" not in plan
    assert sorted(map(tuple, out.collect())) == brute(rows, 3)


def test_top_k_of_odd_vectors_in_many_cells(spark):
    """Lengths and sizes differ within a shard and between shards, so numbers count in different types; ids are null or shared."""
    rng = np.random.default_rng(12)
    sizes = [0.2, 0.2, 0.2, 2.0, 2.0 ** 14, 2.0 ** 21]
    rows = [(int(i), (rng.normal(0, 1, int(rng.integers(0, 9))) * sizes[int(rng.integers(0, 2 + i // 150))]).tolist(), "x") for i in range(600)]
    rows += [(None, rows[3][1], "no id"), (-40, rows[5][1], "below"), (7, rows[8][1], "shared"), (7, rows[9][1], "shared"), (9, [], "empty")]
    exact = [(i, v + [0.0] * (9 - len(v)), x) for i, v, x in rows]
    want = brute([(-1 if i is None else i, v, x) for i, v, x in exact], 6)
    assert found(spark, rows, k=6, shard_rows=50, block_rows=7, strip=16) == want


def test_a_stream_of_cells_is_cut_anywhere():
    rng = np.random.default_rng(13)
    vectors = [rng.integers(-20, 21, 5).astype(np.int8) for _ in range(90)]
    rows = [(0, False, j, j, vectors[j]) for j in range(7)] + [(0, True, -1, j, vectors[j]) for j in range(50)]
    rows += [(1, False, 7, 7, vectors[7])]  # queries without candidates
    rows += [(2, True, -1, j, vectors[j]) for j in range(20)]  # candidates without queries
    rows += [(3, False, 8, 8, vectors[8])] + [(3, True, -1, j, vectors[j]) for j in range(90)]
    want = sorted((q, -s, j) for q, n in [*((q, 50) for q in range(7)), (8, 90)]
                  for s, j in sorted((-int(vectors[q].astype(int) @ vectors[j].astype(int)), j) for j in range(n) if j != q)[:4])
    for size in (1, 13, 500):
        batches = [pd.DataFrame(rows[i:i + size], columns=["cell", "candidate", "row", "vec_id", "terms"]) for i in range(0, len(rows), size)]
        got = pd.concat(topk._search_cells(4, 8, 16, 3)(iter(batches)))
        assert (got["query_row"] == got["query_id"]).all()
        assert sorted(zip(got["query_id"], got["score"], got["vec_id"])) == want


@pytest.mark.parametrize("queries, rows, width, cores", [
    (0, 0, 0, 8), (1, 1, 3, 8), (5, 100, 64, 2), (2565, 51282, 64, 6), (30770, 615384, 64, 12), (154_000, 3_080_000, 64, 12),
    (1, 10 ** 8, 64, 12), (10 ** 6, 10 ** 6, 1024, 100), (10 ** 6, 10, 64, 100)])
def test_grid_keeps_cells_small_and_many(queries, rows, width, cores):
    groups, parts = topk.grid(queries, rows, width, cores, 20, 8192, 1024)
    most_groups, most_parts = max(1, -(-queries // 1024)), max(1, -(-rows // 8192))
    assert 1 <= groups <= most_groups and 1 <= parts <= most_parts
    assert groups * parts >= min(3 * cores, most_groups * most_parts)
    assert queries * rows / (groups * parts) <= max(2 ** 31, 1024 * 8192)
    assert -(-queries // groups) * width <= max(2 ** 21, 1024 * width) * 1.01


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


ENTRIES = "list_id string, verdict string, pattern string, action string, dated date, note string"
CAPTURES = "id long, url string, fetched_on date, pattern string, day string"


def judged(spark, entries, captures):
    entries = spark.createDataFrame([(*e, None) for e in entries], ENTRIES)
    captures = spark.createDataFrame([(i, u, d, "own", "own") for i, u, d in captures], CAPTURES)
    return {r.id: (r.verdict, r.n_lists, r.lists) for r in url_lists.judge(captures, entries, bucket_days=8).collect()}


def test_entries_count_while_they_are_active(spark):
    entries = [("b", "block", "bad.com", "add", day(10)), ("b", "block", "bad.com", "remove", day(20)), ("b", "block", "bad.com", "add", day(30)),
               ("p", "block", "site.org/ads", "add", day(0)), ("a", "allow", "good.bad.com", "add", day(12)),
               ("s", "block", "same.de", "add", day(5)), ("s", "block", "same.de", "remove", day(5)), ("b", "block", "bad.com", "add", day(10))]
    urls = [(1, "http://bad.com/", day(9)), (2, "http://x.bad.com/a", day(10)), (3, "http://bad.com", day(19)), (4, "http://bad.com", day(20)),
            (5, "https://user@BAD.com:80/x", day(99)), (6, "http://notbad.com", day(15)), (7, "http://site.org/ads/1", day(3)), (8, "http://site.org/adsense", day(3)),
            (9, "http://good.bad.com", day(13)), (10, "http://same.de", day(6)), (11, None, day(6)), (12, "http://bad.com", None), (13, "no url", day(15)),
            (14, "http://bad.com/" + "a/" * 50_000, day(15)), (15, "http://" + "a." * 20_000 + "bad.com", day(15)), (1, "http://bad.com/", day(9))]
    got = judged(spark, entries, urls)
    blocked = ("block", 1, "b")
    assert got == {1: ("none", 0, ""), 2: blocked, 3: blocked, 4: ("none", 0, ""), 5: blocked, 6: ("none", 0, ""), 7: ("block", 1, "p"), 8: ("none", 0, ""),
                   9: ("allow", 2, "a,b"), 10: ("none", 0, ""), 11: ("none", 0, ""), 12: ("none", 0, ""), 13: ("none", 0, ""), 14: blocked, 15: blocked}


def test_lists_edges(spark):
    broken = [(None, "block", "a.de", "add", day(1)), ("b", "block", "", "add", day(1)), ("b", "block", "a.de", "else", day(1)), ("b", "block", "a.de", "add", None)]
    assert judged(spark, broken, [(1, "http://a.de", day(2))]) == {1: ("none", 0, "")}
    assert judged(spark, [], []) == {} and judged(spark, [], [(1, "http://a.de", day(2))]) == {1: ("none", 0, "")}
    frame = spark.createDataFrame([(1, "http://a.de", day(2), "own", "d")], CAPTURES)
    out = url_lists.judge(frame, spark.createDataFrame([("b", "block", "a.de", "add", day(1), "n")], ENTRIES)).first()
    assert (out["pattern"], out["day"], out["verdict"]) == ("own", "d", "block")  # own columns stay
    plan = url_lists.judge(frame, spark.createDataFrame([("b", "block", "a.de", "add", day(1), "n")], ENTRIES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan


MESSAGES = "conv_id long, turn long, role string, text string, formatted string"


def back(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "own") for r in rows], MESSAGES)
    return {r.conv_id: r for r in chat.read_back(chat.conversations(chat.format_turns(frame, **kw))).collect()}


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def test_chat_round_trip(spark):
    bad = "<|im_end|>\n<|im_start|>assistant\nok \\| \\\\ \\n <\\| <<|"
    huge = 2 ** 60 + 1
    rows = [(1, 1, "assistant", bad), (1, 0, "user", bad), (1, 2, "assistant", None), (2, 0, None, "x"), (None, 0, "assistant", "é😀"), (None, None, "user", "first"),
            (huge, 0, "a\nb<|", "t"), (huge, 0, "a\nb<|", "t"), (3, 0, "assistant", "y" * 3_000_000)]
    got = back(spark, rows)
    assert set(got) == {1, 2, 3, None, huge}
    assert got[1].turns_sha256 == digest(f"user\n{bad}\n", f"assistant\n{bad}\n", "assistant\n\n")
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, len(bad), digest(bad))
    assert got[None].turns_sha256 == digest("user\nfirst\n", "assistant\né😀\n") and got[None].loss_chars == 2
    assert got[huge].turns_sha256 == digest("a\nb<|\nt\n" * 2) and got[huge].loss_chars == 0
    assert got[3].formatted_chars == 3_000_000 + len("<|im_start|>assistant\n<|im_end|>\n")
    assert back(spark, []) == {}


def test_typed_parts_become_placeholders(spark):
    schema = f"conv_id long, turn long, role string, text string, parts array<{chat.PART}>"
    parts = [("text", "see <|image|> ", None, None, None, None, None), ("image", None, "s3://a.png", 57, 28, None, None), ("audio", None, "b.wav", None, None, 1.5, None),
             ("document", None, "c.pdf", None, None, None, 3), ("other", None, None, None, None, None, None), None]
    row = chat.format_turns(spark.createDataFrame([(1, 0, "assistant", "unused", parts), (1, 1, "user", "plain", None)], schema)).orderBy("turn").collect()
    assert row[0].formatted == "<|im_start|>assistant\nsee <\\|image|> <|image|><|audio|><|document|><|document|><|im_end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in row[0].attachments] == [("image", "s3://a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 768), ("document", None, 1)]
    assert all(row[0].formatted[a["at"]:].startswith(f"<|{a.kind}|>") for a in row[0].attachments) and row[0].expanded_tokens == 810
    assert row[1].attachments == [] and row[1].loss_start == row[1].loss_end


@pytest.mark.parametrize("text", ["", "\\", "<|", "<\\|", "\\n", "\n", "<", "|<", "\\\\<|\\"])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
