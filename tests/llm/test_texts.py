"""Near duplicates, toxicity, main text, packing, BPE, quality and language-model scoring."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailsieve.llm import bpe, components, lm, main_text, near, packing, quality, toxicity

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, key string"
WHITE = r"[\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def vocabulary():
    return P.path("byte_bpe_50k.json")


def docs(spark, *texts, lang="en", source="s"):
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang, source, None, 7, 0.5, "own") for i, t in rows], DOCS)


HUGE = 2 ** 60 + 1
EDGES = [(0, None), (1, ""), (2, " \n\t "), (None, "no id here"), (HUGE, "one two three"), (HUGE, "one two three"), (5, "x" * 300_000), (6, "word " * 60_000)]


# near duplicates

def shingles(text):
    w = [x for x in re.split(WHITE, (text or "").lower()) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_near(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = {i: {j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9} for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (min(seen), len(links[i]))
    return out


def variants(rng, n):
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for base in range(12):
        text = rng.choices(words, k=rng.randint(30, 200))
        for _ in range(n if base == 0 else rng.randint(1, 6)):
            new = list(text)
            for _ in range(rng.randint(0, max(1, len(new) // 40))):
                new[rng.randrange(len(new))] = rng.choice(words)
            rows.append(" ".join(new))
    passage = " ".join(rng.choices(words, k=25))
    rows += [" ".join(rng.choices(words, k=rng.randint(5, 60))) + " " + passage for _ in range(40)]
    rows += [rows[3]] * 5 + ["a b c", "A  b\nc", "a b"]
    return rows


def test_links_and_classes_equal_brute_force(spark):
    rows = list(enumerate(variants(random.Random(3), 60)))
    rules = near.JaccardRules(block=16)  # groups are cut into several blocks
    got = {r.doc_id: (r.class_id, r.n_links) for r in near.near_classes(docs(spark, *rows), rules).collect()}
    assert got == brute_near(rows)


def test_near_edges(spark):
    got = collections.Counter(tuple(r) for r in near.near_classes(docs(spark, *EDGES)).collect())
    assert got == {(0, 0, 0): 1, (1, 1, 0): 1, (2, 2, 0): 1, (None, None, 0): 1, (HUGE, HUGE, 1): 2, (5, 5, 0): 1, (6, 6, 0): 1}
    assert near.near_classes(docs(spark)).collect() == []


def test_pruning_keeps_what_may_reach_the_threshold():
    rules = near.JaccardRules()
    for n, least in rules.needed():
        below = sum(math.comb(n, m) * 0.8 ** m * 0.2 ** (n - m) for m in range(least))
        assert below < 1e-5  # a pair at the threshold is dropped so rarely
    assert rules.needed()[-1][1] > 30


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if find(x) != x}


# toxicity

def test_channel_restores_hidden_words():
    counts = np.zeros(64 ** 3, np.int64)
    text = " the idiot is stupid a moron and pathetic worthless clown is here all day for the loser " * 50
    code = toxicity._TABLE[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(int)
    np.add.at(counts, (code[:-2] << 12) | (code[1:-1] << 6) | code[2:], 1)
    channel = toxicity.Channel(counts)
    for written, plain in (("1d10t", "idiot"), ("id-i0t", "idiot"), ("sssstuuupid", "stupid"), ("$tup1d", "stupid"), ("m.o.r.o.n", "moron"), ("p@th3tic", "pathetic"), ("worthless", "worthless")):
        assert channel.restore(written) == plain
    reader = toxicity.Reader(channel)
    assert "idiot" in reader.words("an i d i o t here") and reader.words(None) == set()


def test_reader_and_score_decode_every_odd_word():
    counts = np.zeros(64 ** 3, np.int64)
    text = " the idiot is stupid a moron and shit pathetic worthless clown is here all day for the loser " * 50
    code = toxicity._TABLE[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(int)
    np.add.at(counts, (code[:-2] << 12) | (code[1:-1] << 6) | code[2:], 1)
    reader = toxicity.Reader(toxicity.Channel(counts))
    scorer = toxicity.Scorer(toxicity.ToxicityModel(counts, {f"{w} ": 5.0 for w in ("idiot", "stupid", "moron", "shit")}, np.array([-3.0, 1, 0, 0, 0, 0])))
    for written, plain in (
            ("1d107", "idiot"), ("5h17", "shit"), ("$h!7", "shit"), ("sh!7", "shit"), ("stuupid", "stupid"), ("iidioott", "idiot"), ("mmoorroonn", "moron"),
            ("*diot", "idiot"), ("stupi*", "stupid"), ("!d10t,", "idiot"), ("5h!7", "shit")):
        assert plain in reader.words(f"so {written} here"), written
        assert scorer.score(f"so {written} here") > 0.5 > scorer.score("so it is here")
    for spaced in ("an  i  d i   o t  here", "i\nd\ni\no\nt\n"):
        assert any(w.startswith("idiot") for w in reader.words(spaced))
    assert {"clown"} <= reader.words("clown!") and reader.words("--- ...") == set()


def _counts(text):
    counts = np.zeros(64 ** 3, np.int64)
    code = toxicity._TABLE[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(int)
    np.add.at(counts, (code[:-2] << 12) | (code[1:-1] << 6) | code[2:], 1)
    return counts


def test_masked_letters_all_come_back():
    channel = toxicity.Channel(_counts(" the idiot is here " * 50))
    for written in ("i***t", "i****", "*d***", "1****", "i*-*-*t"):
        assert channel.restore(written) == "idiot", written
    scorer = toxicity.Scorer(toxicity.ToxicityModel(channel_counts := _counts(" the idiot is here " * 50), {"idiot ": 5.0}, np.array([-3.0, 1, 0, 0, 0, 0])))
    assert channel_counts.sum() and all(scorer.score(f"so {w} here") > 0.5 for w in ("i****", "1d107", "i***t", "(i****)"))
    assert all(scorer.score(t) < 0.5 for t in ("so **** here", "*****", "so it is *here* and ***there***"))


def _cheapest(channel, written):
    """The least cost over all paths, one by one."""
    def walk(steps, one, two, paid):
        if not steps:
            return paid + channel.cost[one, two, 0]
        return min(walk(steps[1:], two, k, paid + price + channel.cost[one, two, k]) if k >= 0 else walk(steps[1:], one, two, paid + price)
                   for _, k, price in steps[0])
    return walk(channel.lattice(written), 0, 0, 0.0)


def _least_cost_of(channel, written, restored):
    """The least cost among the paths that read ``restored``."""
    def walk(steps, rest, one, two, paid):
        if not steps:
            return paid + channel.cost[one, two, 0] if not rest else np.inf
        return min((walk(steps[1:], rest[1:], two, k, paid + price + channel.cost[one, two, k]) if k >= 0 else walk(steps[1:], rest, one, two, paid + price)
                    for x, k, price in steps[0] if k < 0 or rest[:1] == x), default=np.inf)
    return walk(channel.lattice(written), restored, 0, 0, 0.0)


def test_decoding_finds_the_cheapest_of_all_paths():
    channel = toxicity.Channel(_counts(" the idiot is stupid a moron and shit pathetic worthless clown is here all day for the loser " * 50))
    rng = random.Random(8)
    words = ["i***t", "***", "1d107", "st**id", "**1**", "a-b-*", "mm00rr", "$h!7", "1|1!"] + ["".join(rng.choices("abt1!*-s0", k=rng.randint(1, 6))) for _ in range(60)]
    for written in words:
        if written.count("*") <= 3:
            best = _cheapest(channel, written)
            assert _least_cost_of(channel, written, channel.restore(written)) == pytest.approx(best, abs=1e-3), written
            assert _least_cost_of(channel, written, channel._restore_masked(channel.lattice(written))) == pytest.approx(best, abs=1e-3), written


def test_long_masked_words_need_blocks_and_words_without_a_path_to_a_feature_score_nothing():
    channel = toxicity.Channel(_counts(" the idiot is here " * 50))
    written = "i***t" * 150  # 750 characters: three blocks
    channel.BLOCK = 10_000
    whole = channel.restore(written)
    channel.BLOCK = 64
    assert channel.restore(written) == whole and whole.startswith("idiot")
    features = {"idiot ": 4.0, "stup": 3.0, "mor": 2.0}
    scorer = toxicity.Scorer(toxicity.ToxicityModel(_counts(" the idiot is stupid a moron here letter " * 50), features, np.array([-3.0, 1, 0, 0, 0, 0])))
    rng = random.Random(2)
    words = ["letter", "1d10t", "stuupid", "mooron", "m0r", "id1ots", "1d10", "s*upid", "book", "100", "***"] + ["".join(rng.choices("idotsup1!0m", k=rng.randint(1, 7))) for _ in range(300)]
    for word in words:
        restored = [*scorer.reader.written(word)[0], *map(scorer.reader.channel.restore, scorer.reader.written(word)[1])]
        assert scorer._token(word) == max(map(scorer.word, restored), default=0.0)


def test_toxicity_learns_and_scores_held_out_rows(spark, sf):
    larger = sf.replace("sf0.001", "sf0.01")  # a few dozen toxic rows
    table, labels = (spark.read.parquet(f"{larger}/{n}.parquet") for n in ("documents", "labels"))
    may = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0
    model = toxicity.learn(table, labels, may)
    held = toxicity.score(table.select("doc_id", "text"), model).join(labels, "doc_id").where(~may).collect()
    assert sum(r.predicted == r.toxic for r in held) >= 0.9 * len(held)
    edges = toxicity.score(docs(spark, *EDGES), model).collect()
    assert len(edges) == len(EDGES) and all(0 <= r.score <= 1 for r in edges) and {r.key for r in edges} == {"own"}
    none = toxicity.learn(docs(spark), labels.limit(0), may)
    assert {r.score for r in toxicity.score(docs(spark, "x", None), none).collect()} == {0.5}
    assert toxicity.score(docs(spark), none).collect() == []


# main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><div>Site</div></header>
<nav><a href="/">Home</a><a href="/b">More</a></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies, accept?</div>
<article><h1>Head &amp; line</h1><p>One&nbsp;two <b>bold</b>
 three, a sentence that is long enough to be taken for what it is: content.</p><script>var x="</p>";</script><ul><li>item a<li>item b</ul><p>End.</p></article>
<aside>Other stories, this text is long and has a full stop. It is not content at all.</aside><section id="comments"><article class="comment"><p>A reader's comment, quite long. It says a lot of things.</p></article></section>
<form><label>Mail</label></form><footer>&copy; 2024</footer></body></html>"""


def test_main_text_of_a_page(spark):
    want = "Head & line\nOne two bold three, a sentence that is long enough to be taken for what it is: content.\nitem a\nitem b\nEnd."
    rows = [(1, PAGE), (2, None), (3, ""), (4, "<p>plain"), (5, "a < b <3 </x> <p title=\"a>b\">c"), (HUGE, PAGE), (HUGE, PAGE), (None, "<div><a href='x>y"), (7, "<div>" * 30_000 + "deep, but there."), (8, "<!--"), (9, "<" * 5000)]
    frame = spark.createDataFrame([(i, "u", h, "own", -1) for i, h in rows], "page_id long, url string, html string, text string, n_chars long")
    got = [(r.page_id, r.text, r.n_chars) for r in main_text.extract(frame).collect()]
    assert got[0] == (1, want, len(want)) and got[5] == got[6] == (HUGE, want, len(want))
    assert got[1:4] == [(2, "", 0), (3, "", 0), (4, "plain", 5)] and got[4][1] == "a < b <3\nc" and got[8][1] == "deep, but there."
    assert main_text.extract(frame.limit(0)).collect() == []


def test_minimum_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(1, 9)
        gain = [rng.choice([-3, -1, 0, 1, 2, 4]) for _ in range(n)]
        edges = [(i, j, rng.randint(0, 3)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(sides):
            return (sum(max(0, g) for g, s in zip(gain, sides) if not s) + sum(max(0, -g) for g, s in zip(gain, sides) if s)
                    + sum(c for a, b, c in edges if sides[a] != sides[b]))
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(main_text.minimum_cut(gain, edges)) == pytest.approx(best)


# tokens

def test_codec_equals_the_library(vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    library, codec = tokenizers.Tokenizer.from_file(vocabulary), bpe.Codec(vocabulary)
    rng = random.Random(1)
    letters = " \n\t  abcÀñ1½'s’ \x1c\x85　.,<|>\0_😀"
    texts = ["", " ", "it's we'll", "<|endoftext|>a<|endoftext|> <|endoftext|>", "日本語 テスト", "a" * 20_000, " " * 3000 + "x", "x \n y", "a  b", "a "]
    texts += ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(3000)]
    for text in texts:
        want, got = library.encode(text, add_special_tokens=False).ids, codec.encode(text)
        assert (got.ids, got.n_tokens, got.decimals) == (want, len(want), ",".join(map(str, want)))
        assert got.decoded == codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_coded_rows(spark, vocabulary):
    rows = bpe.coded(docs(spark, *EDGES).withColumn("ids", F.lit("own")), vocabulary)
    again = bpe.decoded(rows, vocabulary, output="back").collect()
    assert [r.decoded for r in again] == [t or "" for _, t in EDGES] == [r.back for r in again] and [r.doc_id for r in again] == [i for i, _ in EDGES]
    assert bpe.coded(docs(spark), vocabulary).collect() == []


def pieces_of(spark, vocabulary, frame, **kw):
    return packing.pack(frame, lambda: packing.library_ids(vocabulary), **kw).collect()


def test_pieces_are_cut_at_line_breaks_where_words_end(vocabulary):
    assert bpe.pieces("a b.\nC d\n") == ["a", " b.", "\n", "C", " d", "\n"]
    rng, library = random.Random(3), Tokenizer.from_file(vocabulary)
    codec, ids = bpe.Codec(vocabulary), packing.LibraryIds(vocabulary)
    for _ in range(3000):
        text = "".join(rng.choices(["a", "Äb", " ", "\n", ".", "'s", "1", "\xa0", "\x85", "\x1c", "\0", "\t", "$"], [6, 3, 5, 3, 2, 1, 1, .2, .2, .2, .2, .2, 1], k=rng.randint(1, 12)))
        want = library.encode(text, add_special_tokens=False).ids
        assert "".join(bpe.pieces(text)) == text and all(bpe.pieces(text))
        assert codec.encode(text).ids == want and np.frombuffer(ids(text), "<u4").tolist() == want


def test_a_full_table_keeps_its_pieces_until_the_texts_change(vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 100)
    monkeypatch.setattr(bpe, "REMEMBERED", 100)
    rng, library = random.Random(4), Tokenizer.from_file(vocabulary)
    common = " " + " ".join(f"{a}{b}" for a in "abcd" for b in "efghi")
    rare = ["".join(rng.choices("klmnopqrstuv", k=9)) for _ in range(4000)]
    for codec, ids_of in ((coder := bpe.Codec(vocabulary), lambda t: coder.encode(t).ids), (bytes_of := packing.LibraryIds(vocabulary), lambda t: np.frombuffer(bytes_of(t), "<u4").tolist())):
        codec.known.window = 2000
        for i in range(1000):
            text = f"{common} {rare[i]}"
            assert ids_of(text) == library.encode(text, add_special_tokens=False).ids
        assert len(codec.known) == 100 and all(f" {w}" in codec.known for w in common.split())
        for i in range(1000, 4000):
            assert ids_of(f" {rare[i]}") == library.encode(f" {rare[i]}", add_special_tokens=False).ids
        assert len(codec.known) <= 100 and " ae" not in codec.known


def test_packing_loses_and_repeats_nothing(spark, vocabulary):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["alpha", "Beta", "gamma,", "délta", "1234"], k=rng.choice([0, 1, 30, 200, 900]))) for _ in range(300)]
    rows = pieces_of(spark, vocabulary, docs(spark, *texts).repartition(5), size=256, open_windows=8, groups=3)
    library = Tokenizer.from_file(vocabulary)
    whole = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for i, t in enumerate(texts)}
    got, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(whole[r.doc_id][4 * r.start:4 * (r.start + r.length)]) and r.doc_tokens == len(whole[r.doc_id]) // 4
    for parts, total in [(p, len(whole[i]) // 4) for i, p in got.items()] + [(w, None) for w in windows.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == total if total else at <= 256
    assert set(got) == set(whole)
    assert sum(256 - sum(n for _, n in w) for w in windows.values()) <= 0.02 * sum(len(b) // 4 for b in whole.values()) + 256


def test_packing_uses_the_librarys_ids(vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)  # so that both generations are used up
    rng = random.Random(6)
    library, ids = Tokenizer.from_file(vocabulary), packing.LibraryIds(vocabulary)
    letters = ["a", "the", "Ü", "\n", "\n\n", " ", "  ", "\t", ".", ",\n", "'s", "12", "…", "日本", "\u00a0", "\x1c", "👍", "end.\nNext", "can't", "<|endoftext|>"]
    for text in [t for _, t in EDGES if t] + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(1500)]:
        assert ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_edges(spark, vocabulary):
    rows = pieces_of(spark, vocabulary, docs(spark, *EDGES))
    ids = packing.library_ids(vocabulary)
    got = collections.Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert got == collections.Counter((i, len(ids(t)) // 4 + 1) for i, t in EDGES)
    assert pieces_of(spark, vocabulary, docs(spark)) == []


# quality

def brute_statistics(text):
    text = text or ""
    words = [w for w in re.split(WHITE, text) if w]
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.sub(WHITE, "", line):
            again += line in seen
            seen.add(line)
    tri = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(tri)
    covered = {i + j for i, t in enumerate(tri) if times[t] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def test_statistics_equal_brute_force(spark, sf):
    odd = ["a b a b a b", "x y\x1cz\x85w", "l\nl\n \nl \n \nl", "#*$%&|<>é<", "a b c a b c", "😀 é\r\nq", "a b c\na b c"]
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [*table, *((10_000 + i, t) for i, t in enumerate(odd)), *((20_000 + i, t) for i, (_, t) in enumerate(EDGES))]
    texts = dict(rows)
    for r in quality.with_verdict(docs(spark, *rows)).collect():
        want = brute_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_outliers_go_and_groups_differ(spark):
    rng = random.Random(6)
    def text(symbol=""):
        return "\n".join(" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) + symbol for _ in range(20)) for _ in range(rng.randint(4, 12)))
    rows = [(i, text()) for i in range(300)] + [(1000 + i, text("%%%")) for i in range(20)]
    frame = docs(spark, *rows).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a")).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en"))
    kept = {r.doc_id for r in quality.with_verdict(frame, quality.QualityRules(least_rows=30)).where("kept").collect()}
    assert kept == set(range(300))
    good = quality.keep_good(frame, quality.QualityRules(least_rows=30))
    assert good.columns == frame.columns and {r.doc_id for r in good.collect()} == kept
    assert quality.with_verdict(docs(spark)).collect() == [] and quality.keep_good(docs(spark)).collect() == []


def test_estimate_is_the_least_determinant_of_all_subsets(spark):
    """Twelve rows a group, four of them far off together: the nine closest of all 220 choices, by trying each."""
    rng, rules = np.random.default_rng(11), quality.QualityRules(floors=(1e-6,) * 5)
    groups = {f"g{g}": np.concatenate([rng.normal(g, 1, (9, 5)), rng.normal(30 * (-1) ** g, 1, (3, 5))]) for g in range(4)}
    rows = spark.createDataFrame(
        [(k, i % 3, *map(float, x)) for k, v in groups.items() for i, x in enumerate(v)], "key string, salt int, " + ", ".join(f"x{i} double" for i in range(5)))
    got = {r.key: r for r in quality.group_estimates(rows, rules).collect()}
    for key, points in groups.items():
        best = min((points[list(c)] for c in itertools.combinations(range(12), 9)), key=lambda p: np.linalg.det(np.cov(p.T, bias=True)))
        assert [got[key][f"m{i}"] for i in range(5)] == pytest.approx(best.mean(axis=0))
        inverse = np.linalg.inv(np.cov(best.T, bias=True) * rules.widen)
        assert [got[key][f"w{i}{j}"] for i in range(5) for j in range(i, 5)] == pytest.approx([inverse[i, j] for i in range(5) for j in range(i, 5)])


def test_a_step_of_the_estimate_costs_few_jobs(spark, monkeypatch):
    """Each job costs the driver memory; a step takes two rounds of broadcast, combining and writing."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame(
        [(f"g{i % 3}", i % 64, *map(float, x)) for i, x in enumerate(rng.standard_t(2, (3000, 5)))], "key string, salt int, " + ", ".join(f"x{i} double" for i in range(5)))
    rows = quality.materialize(rows)
    steps, summed = [], quality._summed
    monkeypatch.setattr(quality, "_summed", lambda *a: (steps.append(1), summed(*a))[1])

    def next_job(name):
        spark.sparkContext.setJobGroup(name, name)
        spark.sparkContext.parallelize([1], 1).count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return spark.sparkContext.statusTracker().getJobIdsForGroup(name)[0]

    first = next_job("before the estimate")
    assert quality.group_estimates(rows, quality.QualityRules()).count() == 3
    assert len(steps) > 4 and next_job("after the estimate") - first <= 6 * len(steps) + 8


def test_repeated_lines_alone_reject(spark):
    rng = random.Random(8)
    def lines(n):
        return [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(12)) for _ in range(n)]
    rows = [(i, "\n".join(lines(20))) for i in range(250)]
    again = ["\n".join(lines(12) + ["read more"] * 30) for _ in range(5)]
    got = {r.doc_id: r for r in quality.with_verdict(docs(spark, *rows, *((1000 + i, t) for i, t in enumerate(again)))).collect()}
    assert all(got[i].kept for i in range(250))
    assert all(not got[1000 + i].kept and not got[1000 + i].base_failed and got[1000 + i].n_symbols == 0 for i in range(5))


# language model

def tokens_of(text):
    return [w for w in re.split(WHITE, re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if w] + [None]


def test_counts_equal_brute_force_and_scores_beat_them(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(90_000 + i, t) for i, (_, t) in enumerate(EDGES[:-2])]
    counts = collections.Counter(w for i, t in rows if i % 5 for w in tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    rules = lm.ModelRules(chunk_bytes=100_000, range_bytes=50_000, share=1)
    got = {r.doc_id: r for r in lm.scored(docs(spark, *rows), F.col("doc_id") % 5 != 0, rules).collect()}
    score = base = 0.0
    for i, t in rows:
        want = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens_of(t))
        assert got[i].base_score == pytest.approx(want, rel=1e-9) and got[i].n_tokens == len(tokens_of(t)) and got[i].train_tokens == n
        assert got[i].n_known == sum(counts[w] > 0 for w in tokens_of(t))
        if not i % 5:
            score, base = score + got[i].score, base + want
    assert score > base
    empty = lm.scored(docs(spark, None, "a b"), F.lit(False)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in empty) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert lm.scored(docs(spark), F.lit(True)).collect() == []
    assert len(lm.scored(docs(spark, *EDGES), F.lit(True), lm.ModelRules(share=1)).collect()) == len(EDGES)


def test_gradients_and_carried_state():
    rng = np.random.default_rng(0)
    model = lm.Gru(np.array([9, 8, 7, 6, 5, 4, 3, 2]), 60, lm.ModelRules(hidden=3, class_size=4, classes=2))
    texts = [rng.integers(0, 9, 30), rng.integers(0, 9, 11)]
    whole = model.log_probabilities(texts, window=64)
    assert model.log_probabilities(texts, window=5) == pytest.approx(whole, rel=1e-5)  # windows do not matter
    found = {}
    trainer = lm.Trainer(model)
    trainer._update = lambda gradient, n: found.update(gradient)
    trainer.learn(texts)
    for name, at in (("recurrent", (1, 4)), ("class_out", (2, 1)), ("word_out", (3, 0)), ("word_bias", (2,)), ("table", (int(texts[0][0]), 7))):
        kept = model.parameters[name][at]
        sides = []
        for step in (2e-2, -2e-2):
            model.parameters[name][at] = kept + step
            sides.append(-model.log_probabilities(texts).sum())
        model.parameters[name][at] = kept
        assert found[name][at] == pytest.approx((sides[0] - sides[1]) / 4e-2, rel=0.05, abs=2e-3)
    total = sum(np.exp(model.log_probabilities([np.array([t])]))[0] for t in range(model.size + 1))
    assert total == pytest.approx(1, rel=1e-4)


def test_all_training_documents_are_learned_from(spark, sf):
    rules = lm.ModelRules()
    rows = docs(spark, *(" ".join([f"own{i}"] * 5) for i in range(60))).withColumn("learned", F.col("doc_id") % 5 != 1)
    found = lm.unigrams(rows, rules)
    began, ended = lm.Gru(found.frequent_counts, found.tokens, rules), lm.train(rows, found, rules)
    moved = (began.parameters["table"] != ended.parameters["table"]).any(axis=1)[:len(found.frequent)]
    assert len(moved) == 49 and moved.all()  # 48 words of training documents and the end
    allowed = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 1
    got = lm.scored(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), allowed).where(~allowed).agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
