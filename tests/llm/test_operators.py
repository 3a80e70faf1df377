"""Operators of the llm subpackage on small fixtures, against brute force."""

from __future__ import annotations

import base64
import collections
import hashlib
import json
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import ann, bpe, components, langid, lattice_lm, lines, mixing, pivots, quality, simhash, wacz

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
EDGE_TEXTS = [None, "", " ", "\n\n", "a", "A b", "word " * 4000, "x" * 30_000, "Été ß 中文 😀", "same text here for all", "same text here for all", "tab\there\x0bform\x0c"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns whose names clash with the operators' own."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else f"src{i}", None if t is None else len(t), "extra", 1.5) for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[4], rows[4], (None, "a null id", None, None, None, None, None)]
    return frame(spark, rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, score double")


@pytest.fixture(scope="module")
def no_docs(spark, edge_docs):
    return edge_docs.where("false")


#: Names that operators use inside, and some that need quotes.
CLASHES = ["_id", "_label", "_key", "_spans", "_gone", "gone", "_domain", "_lang", "_source", "_last", "whole", "last", "end", "room", "rest", "range", "n", "c0", "c1", "k", "a", "b", "id", "key", "low", "high",
           "fp", "node", "label", "bands", "s0", "spans", "block", "number", "word", "count", "kind", "part", "v", "y", "t", "h", "text_", "a.b", "x y", "SHARE"]


def test_columns_whose_names_clash_come_back(spark):
    docs = [(i, f"some words number {i} and more", "en" if i % 2 else "fr", "src1", *[f"{name}{i}" for name in CLASHES]) for i in range(8)]
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    table = frame(spark, docs, schema)
    labels = frame(spark, [(i, i % 2, "x", "y") for i in range(8)], "doc_id bigint, quality int, id string, y string")
    found = {
        "lines": lines.deduplicated(table), "simhash": simhash.keep_one_of_each(table), "mixing": mixing.mixed(table),
        "quality": quality.scored(table, quality.fitted(table, labels)), "bpe": bpe.encoded(table, VOCABULARY),
        "langid": langid.identified(table, langid.fitted(table)),
    }
    for name, result in found.items():
        rows = result.collect()
        assert rows, name
        for r in rows:
            assert [r[c] for c in CLASHES] == [f"{c}{r.doc_id}" for c in CLASHES], name
    assert lattice_lm.scored(table, PIECES).count() == simhash.simhash_groups(table).count() == 8


# --- components ----------------------------------------------------------------


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, 5), (None, 2), (7, 8), (8, 7)]
    parent = list(range(300))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in components.components(frame(spark, edges, "a bigint, b bigint"), "a", "b").collect()}
    assert found == {n: root(n) for a, b in edges if a is not None and a != b for n in (a, b)}


# --- 9: SimHash ----------------------------------------------------------------


def brute_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_matches_definition():
    for text in EDGE_TEXTS + ["one two three", "one two three four", "a b c d e f g a b c d"]:
        assert simhash.fingerprint(text, 4) == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [4, 6])
def test_links_find_every_pair_once(spark, radius):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = set(base)
    for b in base:
        for _ in range(6):
            values.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 9))))
    values |= {0, (1 << 64) - 1, 1 << 63}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    got = [(r.left, r.right) for r in simhash.links(frame(spark, signed, "fp bigint"), radius).collect()]
    want = {(a[0], b[0]) for a in signed for b in signed if a[0] < b[0] and bin((a[0] ^ b[0]) & (1 << 64) - 1).count("1") <= radius}
    assert len(got) == len(set(got)) and set(got) == want


def test_simhash_groups_on_edges(spark, edge_docs, no_docs):
    rows = simhash.simhash_groups(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].fp == by_id[1].fp == by_id[2].fp == 0
    assert by_id[0].component_id == by_id[3].component_id == 0
    assert by_id[10].component_id == 9
    assert by_id[None].component_id is None
    assert simhash.simhash_groups(no_docs).count() == 0


def test_keep_one_of_each(spark):
    words = [f"w{i}" for i in range(300)]
    near = words.copy()
    near[150] = "other"
    docs = frame(spark, [(5, " ".join(words), 1), (2, " ".join(near), 2), (9, " ".join(words), 3), (4, "something else entirely", 4)], "doc_id bigint, text string, left int")
    kept = sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect())
    assert 4 in kept and len(kept) == (2 if bin(brute_fingerprint(" ".join(words), 5) ^ brute_fingerprint(" ".join(near), 5)).count("1") <= 6 else 3)


def test_keep_one_of_each_matches_brute_jaccard(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        other = words.copy()
        for at in range(3, 3 + 20 * (i % 6), 20):  # each changes five shingles: similarities from 0.77 to 0.95 and copies
            other[at] = f"x{rng.randrange(5000)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(196)} for i, t in rows}
    want = [i for i, _ in rows if i % 2 == 0 or len(sets[i] & sets[i - 1]) < 0.8 * len(sets[i] | sets[i - 1])]
    got = sorted(r.doc_id for r in simhash.keep_one_of_each(frame(spark, rows, "doc_id bigint, text string")).collect())
    assert got == want and 60 < len(want) < 120


def final_plans(spark, action) -> list[str]:
    """The plans of all executions of an action, as they ended."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = {x.executionId() for x in each(store.executionsList())}
    action()
    bus.waitUntilEmpty(30_000)
    return [x.physicalPlanDescription().split("Initial Plan")[0] for x in each(store.executionsList()) if x.executionId() not in before]


def each(seq):
    return [seq.apply(i) for i in range(seq.size())]


@pytest.mark.parametrize("run", [simhash.keep_one_of_each, simhash.simhash_groups])
def test_simhash_broadcasts_nothing(spark, run):
    """The planner, left alone, broadcast tables that grow with the input (64 variants of each fingerprint) from the driver."""
    rng = random.Random(6)
    words = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(20)]
    rows = [(i, " ".join(words[i % 20] if i < 40 else ["x", *words[i % 20][1:]])) for i in range(60)]
    plans = final_plans(spark, lambda: run(frame(spark, rows, "doc_id bigint, text string")).collect())
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastExchange" in p or "BroadcastNestedLoopJoin" in p]


def test_components_broadcast_nothing(spark):
    edges = frame(spark, [(i, i // 2) for i in range(1, 50)], "a bigint, b bigint")
    plans = final_plans(spark, lambda: components.components(edges, "a", "b").collect())
    assert any("SortMergeJoin" in p for p in plans) and not [p for p in plans if "Broadcast" in p]


# --- 5: BPE --------------------------------------------------------------------


def test_bpe_equals_the_library():
    mine, theirs = bpe.ready(open(VOCABULARY, "rb").read()), Tokenizer.from_file(VOCABULARY)
    rng = random.Random(2)
    bits = ["a", "b", " ", "  ", "the", "ing", "\n", "\x1c", "é", "ß", "中", "😀", "²", "Ⅷ", "'s", "'", "<|endoftext|>", "<|endo", "1", "_", "　", "aa", "tion", "\x85", " "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [t for t in EDGE_TEXTS if t is not None]
    for text, told in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        packed = mine.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == told.ids
        assert mine.decode(packed) == theirs.decode(told.ids, skip_special_tokens=False)


def test_bpe_broken_sequences_decode_like_the_library():
    mine, theirs = bpe.ready(open(VOCABULARY, "rb").read()), Tokenizer.from_file(VOCABULARY)
    ids = [mine.vocab_ids[0xE4], mine.vocab_ids[0x41]]
    assert mine.decode(np.array(ids, "<u4").tobytes()) == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_cache_generations():
    mine = bpe.ByteBpe(open(VOCABULARY, "rb").read())
    mine.CACHE, mine.PAIRS = 5, 7
    whole = bpe.ready(open(VOCABULARY, "rb").read())
    text = " ".join(f"word{i} unusual{i * 7}" for i in range(200))
    assert mine.encode(text) == whole.encode(text) and len(mine.cache) <= 5


def test_encoded_on_edges(spark, edge_docs, no_docs):
    theirs = Tokenizer.from_file(VOCABULARY)
    rows = bpe.encoded(edge_docs, VOCABULARY, decoded="back").collect()
    assert len(rows) == edge_docs.count() and rows[0].key == "extra"
    for r in rows:
        want = theirs.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and r.back == (r.text or "")
    assert bpe.encoded(no_docs, VOCABULARY).count() == 0


# --- 2: lattice LM -------------------------------------------------------------


def test_marginals_and_expectations_match_enumeration():
    pieces, logs = [b" ", b"a", b"b", b" a", b"ab", b"ba", b"aba"], np.log(np.array([0.2, 0.2, 0.1, 0.2, 0.1, 0.1, 0.1]))
    lattice = lattice_lm.Lattice(pieces)

    def cuts(word):
        if not word:
            yield []
        for n in range(1, len(word) + 1):
            if word[:n] in pieces:
                yield from ([word[:n], *rest] for rest in cuts(word[n:]))

    words = [b" a", b" abab", b" bbaab", b" a" + b"ab" * 9, b" b"]
    got, counts = lattice.marginals(words, logs), np.zeros(len(pieces))
    for w, g in zip(words, got):
        mass = [(c, math.exp(sum(logs[pieces.index(p)] for p in c))) for c in cuts(w)]
        total = sum(m for _, m in mass)
        assert g == pytest.approx(math.log(total))
        for c, m in mass:
            for p in c:
                counts[pieces.index(p)] += m / total
    assert lattice.expected(words, logs) == pytest.approx(counts)
    assert lattice.expected(words * 2, logs, np.array([1.0, 1, 1, 1, 1, 2, 2, 2, 2, 2])) == pytest.approx(3 * counts)


def test_long_words_in_blocks_equal_the_plain_recursion():
    pieces, logs = lattice_lm.vocabulary(PIECES)
    plain, cut = lattice_lm.Lattice(pieces), lattice_lm.Lattice(pieces)
    plain.LONG, cut.LONG, cut.SPAN, cut.SIDE = 10**9, 10, 32, 3
    rng = random.Random(8)
    words = [b" " + bytes(rng.choices(b"abcdefghijklmnothe \xc3\xa9", k=n)).replace(b" ", b"e") for n in (9, 10, 31, 32, 33, 64, 97, 500)] + [b" " + b"the" * 200]
    assert cut.marginals(words, logs) == pytest.approx(plain.marginals(words, logs), rel=1e-12)
    assert cut.expected(words, logs) == pytest.approx(plain.expected(words, logs), abs=1e-8)


def test_lm_base_score_and_mixture(spark):
    rng = random.Random(4)
    vocabulary = {"en": ["the", "of", "cat", "house", "stone", "river"], "fr": ["le", "la", "maison", "chat", "pierre", "rivière"]}
    docs = []
    for i in range(120):
        lang = "en" if i % 3 else "fr"
        docs.append((i, " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "", "s"]) for _ in range(rng.randint(0, 30))), lang))
    docs += [(200, None, None), (201, "", "en"), (202, "THE Cat unknownword", "en"), (None, "the null id", "en")]
    got = lattice_lm.scored(frame(spark, docs, "doc_id bigint, text string, lang string"), PIECES).collect()
    assert len(got) == len(docs)
    count = collections.Counter()
    for i, t, _ in docs:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            count.update((t or "").encode().lower().split())
            count[None] += 1
    n, v = sum(count.values()), len(count)
    texts = {i: t for i, t, _ in docs}
    for r in got:
        tokens = (texts[r.doc_id] or "").encode().lower().split() + [None]
        assert r.base_score == pytest.approx(sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(count[t] > 0 for t in tokens), n)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert math.isfinite(r.score) and r.score < 0 and math.isfinite(r.mixture_score) and r.mixture_score < 0


@pytest.mark.parametrize("rounds", [0, 2])
def test_lm_matches_its_formula(spark, rounds):
    """Brute force of both models: expected counts over all training words, then sums over all segmentations."""
    docs = [(i, t) for i, t in enumerate(["a cat sat", "a cat ran", "the dog", "a dog sat", "cat", "the the cat", "dogs", ""])]
    got = {r.doc_id: r for r in lattice_lm.scored(frame(spark, docs, "doc_id bigint, text string"), PIECES, rounds=rounds).collect()}
    train = [t for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1]
    count = collections.Counter(w for t in train for w in t.encode().split())
    n, v = sum(count.values()) + len(train), len(count)
    ones, twos = (sum(c == k for c in count.values()) for k in (1, 2))
    d = min(0.95, max(0.1, ones / (ones + 2 * twos)))
    pieces, logs = lattice_lm.vocabulary(PIECES)
    weight = dict(zip(pieces, np.exp(logs)))

    def cuts(word):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            if word[:k] in weight:
                yield from ([word[:k], *rest] for rest in cuts(word[k:]))

    mass = lambda w: [(c, math.prod(weight[p] for p in c)) for c in cuts(b" " + w)]
    for _ in range(rounds):
        expected = collections.Counter()
        for w, c in count.items():
            whole = sum(m for _, m in mass(w))
            for cut, m in mass(w):
                for p in cut:
                    expected[p] += c * m / whole
        total = sum(expected.values()) + 1e-3 * len(pieces)
        weight = {p: (expected[p] + 1e-3) / total for p in pieces}
    for i, t in docs:
        want = mixed = math.log10(len(train) / n)
        for w in t.encode().split():
            spelt = sum(m for _, m in mass(w))
            want += math.log10(sum(count.values()) / n * spelt)
            mixed += math.log10(max(count[w] - d, 0) / n + d * v / n * spelt)
        assert got[i].score == pytest.approx(want, rel=1e-9) and got[i].mixture_score == pytest.approx(mixed, rel=1e-9)


def test_lm_on_edges(spark, edge_docs, no_docs):
    rows = lattice_lm.scored(edge_docs, PIECES).collect()
    assert len(rows) == edge_docs.count() and all(math.isfinite(r.score) for r in rows)
    assert lattice_lm.scored(no_docs, PIECES).count() == 0
    alone = [(i, "some words") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = lattice_lm.scored(frame(spark, alone, "doc_id bigint, text string"), PIECES).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in rows)


# --- 3: quality ----------------------------------------------------------------


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = quality.Trees().fit(x[:1500], y[:1500])
    assert ((trees.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95

    def walk(row):
        raw = trees.start
        for at in trees.roots:
            for _ in range(trees.depth):
                at = trees.child[at][int(row[trees.feature[at]] > trees.cut[at])]
            raw += trees.value[at]
        return 1 / (1 + math.exp(-raw))

    assert trees.score(x[:50]) == pytest.approx([walk(r) for r in x[:50]])


def test_quality_on_edges(spark, edge_docs, no_docs):
    labels = frame(spark, [(1, 1), (4, 0), (None, 1), (6, None)], "doc_id bigint, quality int")
    rows = quality.scored(edge_docs, quality.fitted(edge_docs, labels)).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    blank = quality.fitted(no_docs, labels.where("false"))
    assert all(r.score == 0.5 for r in quality.scored(edge_docs, blank).collect())
    assert quality.scored(no_docs, blank).count() == 0
    assert all(np.isfinite(quality.statistics(t)).all() and len(quality.statistics(t)) == len(quality.FEATURES) for t in EDGE_TEXTS)


def test_quality_held_out(spark, sf):
    from tessera.llm.quality import op3_quality

    got = {r.doc_id: r for r in op3_quality(spark, sf).collect()}
    told = spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL").collect()
    held = [(got[r.doc_id].predicted, r.quality) for r in told if r.doc_id in got and got[r.doc_id].held_out]
    assert held and sum(a == b for a, b in held) / len(held) > 0.95


# --- 10: language --------------------------------------------------------------


def test_langid_held_out_and_edges(spark, sf, edge_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fitted(docs)
    rows = langid.identified(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    for r in langid.identified(edge_docs, model).collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred != "und") == letters and 0 <= r.score <= 1
    assert langid.fitted(no_docs) is None
    assert all(r.lang_pred == "und" for r in langid.identified(edge_docs, None).collect())
    assert langid.identified(no_docs, model).count() == 0


def test_cnn_windows_cover_the_text():
    net = langid.ByteCnn(["a", "b"])
    raw = bytes(range(1, 200)) * 5
    cut = net.windows(raw)
    padded = raw + bytes(net.WINDOW + net.reach)
    assert all(w.tobytes() == padded[i * net.WINDOW :][: net.WINDOW + net.reach - 1] for i, w in enumerate(cut))
    assert b"".join(w[: net.WINDOW].tobytes() for w in cut).rstrip(b"\0") == raw and len(net.windows(b"")) == 1


def test_cnn_gradients():
    net = langid.ByteCnn(["a", "b", "c"])
    net.WINDOW = 24
    x = np.concatenate([net.windows(b"some text here"), net.windows(b"und andere worte")])
    y = np.array([0, 2])

    def loss():
        z = net.logits(x)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(2), y]).mean())

    for name, g in net._gradients(x, y).items():
        value = getattr(net, name).astype(np.float64)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        ends = []
        for step in (1e-3, -1e-3):
            moved = value.copy()
            moved[at] += step
            setattr(net, name, moved.astype(np.float32))
            ends.append(loss())
        setattr(net, name, value.astype(np.float32))
        assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(g[at], rel=0.05, abs=1e-4)


# --- 4: lines ------------------------------------------------------------------


def brute_repeats(rows, least):
    """Of each document, in order, the words that lie in a run of least words that an earlier place holds too."""
    seen, out = set(), []
    for _, text in rows:
        words = (text or "").split()
        gone = set()
        for i in range(len(words) - least + 1):
            run = tuple(words[i : i + least])
            if run in seen:
                gone.update(range(i, i + least))
            seen.add(run)
        out.append(gone)
    return out


@pytest.mark.parametrize("least", [5, 12, 50])
def test_lines_match_brute_force(spark, least):
    """Passages as lines of their own, glued to other text and inside longer lines: exactly the words of later repeats go."""
    rng = random.Random(least)
    fresh = iter(range(10**9))

    def prose(n):
        return [f"w{next(fresh)}" + rng.choice(["", "", "", "\n", "\n\n"]) for _ in range(n)]

    passages = [prose(least + rng.choice([0, 1, 7, 60])) for _ in range(6)] + [prose(least - 1)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randint(0, 3)):
            parts += [prose(rng.randint(0, 40)), [rng.choice(["", "\n"])], rng.choice(passages), [rng.choice(["", "\n"])]]
        rows.append((i, " ".join(w for p in [*parts, prose(3)] for w in p)))
    rows += [(40, rows[3][1]), (41, None), (42, "")]
    got = {r.doc_id: r for r in lines.deduplicated(frame(spark, rows, "doc_id bigint, text string"), least_words=least).collect()}
    lost = 0
    for (i, text), gone in zip(rows, brute_repeats(rows, least)):
        words = (text or "").split()
        assert (got[i].text or "").split() == [w for k, w in enumerate(words) if k not in gone]
        assert got[i].removed_words == len(gone) and (got[i].removed_lines > 0) == bool(gone)
        lost += len(gone)
    assert lost > 20 * least and got[41].text is None and got[42].text == ""


@pytest.mark.parametrize("least", [1, 5, 12])
def test_lines_of_few_words(spark, least):
    """Where everything repeats somewhere, what goes has an earlier equal, what is unlike stays, and no line's words disappear.

    First occurrences with less than the whole run hide repeats here, so not all of them go.
    """
    rng = random.Random(least)
    pool = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randint(1, 8))) for _ in range(25)]
    rows = [(i, "\n".join(rng.choice([*pool, "", "  "]) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    rows[7] = (7, rows[3][1])
    got = {r.doc_id: r for r in lines.deduplicated(frame(spark, rows, "doc_id bigint, text string"), least_words=least).collect()}
    repeats = brute_repeats(rows, least)
    for (i, text), may in zip(rows, repeats):
        assert got[i].removed_words <= len(may) and len(got[i].text.split()) == len(text.split()) - got[i].removed_words
        if not may:
            assert got[i].text == text
    assert sum(r.removed_words for r in got.values()) > 0
    assert {w for _, t in rows for w in t.split()} == {w for r in got.values() for w in r.text.split()}


def test_line_cuts_and_grams_follow_their_definition():
    rng = random.Random(9)
    texts = ["\n".join(" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 9))).encode() for _ in range(30)]
    words = lines.Words(texts)
    alone = [lines.Words([t]).hash for t in texts]
    assert (words.hash == np.concatenate(alone)).all() and len({tuple(t.split()) for t in texts}) <= len({h.tobytes() for h in alone})
    cut, gram, window = lines.sizes(50)
    told = collections.defaultdict(set)
    for t, _, low, high in zip(*lines.selected(words, 50)):
        told[t].add((low, high))
    for n, text in enumerate(texts):
        split, at, ends = [len(x.split()) for x in text.split(b"\n")], 0, set()
        for size in split:
            ends |= {at + size} if size else set()
            for i in range(size - cut + 1):
                near = alone[n][at + i : at + i + cut].tolist()
                ends.add(at + i + near.index(min(near)) + 1)
            at += size
        ends = sorted(ends)
        starts = [0, *ends[:-1]]
        reach = lambda s, k: next((e for e in ends if e >= s + k), None)  # noqa: B023, E731
        want = {(s, reach(s, gram)) for s in starts} - {(s, None) for s in starts}
        assert told[n] <= want
        for s in starts:  # every window has a selected gram
            if (end := reach(s, window)) is not None:
                assert any(s <= a and b <= end for a, b in told[n])


def test_lines_on_edges(spark, edge_docs, no_docs):
    rows = {(r.doc_id, r.text): r for r in lines.deduplicated(edge_docs, least_words=3).collect()}
    assert (0, None) in rows and rows[(None, "a null id")].removed_lines == 0 and rows[(3, "\n\n")].removed_words == 0
    assert rows[(9, "same text here for all")].removed_lines == 0 and rows[(10, "")].removed_lines == 1
    assert (6, "word word word") in rows
    assert lines.deduplicated(edge_docs).count() == edge_docs.count() and lines.deduplicated(no_docs).count() == 0


# --- 1: pivots -----------------------------------------------------------------


def vectors_table(spark, x, more=()):
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)] + list(more)
    return frame(spark, rows, "vec_id bigint, embedding array<double>, label int")


def test_pivots_match_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    x = np.concatenate([rng.normal(size=(150, 24)), *[c + rng.normal(size=(15, 24)) * s for c, s in zip(centres, np.linspace(0.02, 0.5, 12))]])
    x = np.concatenate([x, x[:10], x[155:160] * 3.0])
    odd = [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 1), (903, [1.0, None] + [0.0] * 22, 1), (904, [float("inf")] * 24, 1), (None, x[0].tolist(), 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1)]
    rows = pivots.near_copies(vectors_table(spark, x, odd), tile=16).collect()
    got = {r.vec_id: r for r in rows}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert len(rows) == len(x) + len(odd)
    found = sum(got[i].n_links for i in range(len(x)))
    assert 0.98 * near.sum() <= found <= near.sum() and all(got[i].n_links <= near[i].sum() for i in range(len(x)))
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(near, label[None], len(x)).min(axis=1))
    assert np.mean([got[i].component_id == label[i] for i in range(len(x))]) > 0.98
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(x)))
    exact = {r.vec_id: r for r in pivots.near_copies(vectors_table(spark, x), tile=64, exact=True).collect()}
    assert all((exact[i].n_links, exact[i].component_id) == (near[i].sum(), label[i]) for i in range(len(x)))
    for i in (900, 901, 902, 903, 904):
        assert got[i].n_links == 0 and got[i].component_id == i
    assert got[905].n_links == got[906].n_links == 1 and got[None].n_links == 0
    assert pivots.near_copies(vectors_table(spark, x).where("false")).count() == 0


# --- 7: nearest neighbours -----------------------------------------------------


def test_ann_recall_and_ties(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.2, 2, size=(1500, 1))
    x[700:760] = x[100]
    odd = [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 1), (None, x[0].tolist(), 1), (5060, [1.0], 0), (0, x[0].tolist(), 0)]
    rows = ann.nearest(vectors_table(spark, x, odd), F.col("vec_id") % 20 == 0).collect()
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        scores = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(len(x)), -scores)) if i != q][:20]
        hits += len({i for i, _ in found} & set(order))
        assert [s for _, s in found] == pytest.approx([scores[i] for i, _ in found], rel=1e-12)
        assert found == sorted(found, key=lambda f: (-f[1], f[0])) and len(found) == 20
    assert hits / (20 * len(got)) >= 0.9


def test_ann_recall_beside_a_dense_group(spark):
    rng = np.random.default_rng(16)
    x = rng.normal(size=(4500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosines = rng.uniform(0.75, 0.95, size=(1500, 1))
    aside = x[:1500] - (x[:1500] @ x[4499])[:, None] * x[4499]
    x[:1500] = cosines * x[4499] + np.sqrt(1 - cosines**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    got = collections.defaultdict(set)
    for r in ann.nearest(vectors_table(spark, x), F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    recall = []
    for q in range(0, 4500, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        recall.append(len(got[q] & set(np.argsort(-scores)[:20].tolist())) / 20)
    assert np.mean(recall[:75]) >= 0.9 and np.mean(recall[75:]) >= 0.9


def test_ann_probes_reach_the_target_at_any_size():
    rng = np.random.default_rng(26)
    sample, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, 2000, 64)))
    hashes, q = ann.Hashes(sample, 1.0, 10_000_000, 20), q[:200]
    near = hashes.near(q)
    aside = rng.normal(size=q.shape)
    aside -= (aside * q).sum(axis=1, keepdims=True) * q
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosines = (1 - near**2 / 2)[:, None]
    cells = hashes.cells(cosines * q + np.sqrt(1 - cosines**2) * aside)
    found = [bool(np.isin(c, p).any()) for c, p in zip(cells, hashes.probes(q)) if len(p)]
    assert len(found) >= 100 and np.mean(found) >= 0.92


def test_ann_cells_of_many_entries_are_sliced(spark, monkeypatch):
    rng = np.random.default_rng(36)
    x = rng.normal(size=(3000, 8))
    x[:1000] = x[0] + 1e-3 * rng.normal(size=(1000, 8))  # a third of the rows in a cell or two of each table
    x = np.round(x, 4)
    made = []
    parts = ann._parts
    monkeypatch.setattr(ann, "PART_BYTES", 64 << 10)
    monkeypatch.setattr(ann, "_parts", lambda *a: made.append(parts(*a)) or made[0])
    got = collections.defaultdict(list)
    for r in ann.nearest(vectors_table(spark, x), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert len(made[0].cells) and made[0].slices.max() > 2
    hits = 0
    for q in range(0, 3000, 20):
        scores = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(3000), -scores)).tolist() if i != q][:20]
        hits += len(set(order) & set(got[q]))
        assert len(got[q]) == len(set(got[q])) == 20
    assert hits / 3000 >= 0.9


def test_ann_parts():
    """Each slice of a cell is where a query looks for it, whatever the hash of the vector."""
    parts = ann.Parts(5, {7: 3, -9: 9, 2**63 - 1: 4})
    cells = np.array([7, -9, 2**63 - 1, 11, -(2**63)])
    visited = {(p, c) for p, own in parts.visited(cells) for c in own}
    held = {(p, c) for i in range(200) for p, own in parts.holding(cells, str(i).encode()) for c in own}
    assert held == visited and len(held) == 3 + 5 + 4 + 1 + 1
    assert ann._batch([]).num_rows == 0


def test_ann_small_tables(spark):
    x = np.random.default_rng(1).normal(size=(6, 4))
    rows = ann.nearest(vectors_table(spark, x), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in rows) == [1, 2, 3, 4, 5] and sorted(r["rank"] for r in rows) == [1, 2, 3, 4, 5]
    assert ann.nearest(vectors_table(spark, x).where("false"), F.col("vec_id") == 0).count() == 0


def test_ann_exact_and_other_lengths(spark):
    x = np.random.default_rng(3).normal(size=(300, 8))
    more = [(1000 + i, [float(i), 1.0, -1.0], 0) for i in range(30)] + [(2000, [1.0] * 5, 0)]
    for exact in (True, False):
        got = collections.defaultdict(list)
        for r in ann.nearest(vectors_table(spark, x, more), F.col("vec_id") % 20 == 0, exact=exact).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        assert set(got) == {*range(0, 300, 20), 1000, 1020}
        assert got[1020] == [1000 + i for i in range(29, 8, -1) if i != 20]
        if exact:
            for q in range(0, 300, 20):
                order = np.lexsort((np.arange(300), -(x * x[q]).sum(axis=1)))
                assert got[q] == [i for i in order.tolist() if i != q][:20]


# --- 6: archives ---------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    big = "é" * 600
    pages = [(1, "http://a/b c?x=%20\n", big), (7, "http://b/", big), (3, None, big), (4, "http://c/", "short"), (5, "http://d/", "short"), (6, "http://e/", None), (None, "http://f/", big), (8, "http://g/", "x" * 999), (9, "http://g/", "x" * 999), (7, "http://b/", big)]
    archives = wacz.archived(frame(spark, pages, "page_id bigint, url string, html string"), f"file://{tmp_path}")
    rows = wacz.archive_records(archives).collect()
    assert len(rows) == len(pages)
    for r in rows:
        html = next((h or "").encode() for i, u, h in pages if i == r.page_id and u == r.url)
        revisit = html == big.encode() and r.page_id != 7
        assert r.record_type == ("revisit" if revisit else "response") and r.refers_to == (7 if revisit else None)
        assert r.payload_digest == hashlib.sha1(html).hexdigest() and r.payload_bytes == len(html)
        assert r.payload == (None if revisit else html)
    none = wacz.archived(frame(spark, [], "page_id bigint, url string, html string"), f"file://{tmp_path}")
    assert none.count() == 0 and wacz.archive_records(none).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directory(zip64):
    import io
    import zipfile

    archive = wacz._Archive(zip64)
    digest = hashlib.sha1(b"payload").hexdigest()
    archive.add(wacz.record(1, "http://a/", b"payload", digest, 7, None), "response", "http://a/", digest)
    raw = archive.bytes()
    read = lambda at, n: raw[at : at + n]
    found = wacz.members(read, len(raw))
    with zipfile.ZipFile(io.BytesIO(raw)) as told:
        assert set(found) == set(told.namelist())
        for name, member in found.items():
            at = wacz.stored_at(read, member)
            assert raw[at : at + member[2]] == told.read(name)
    with pytest.raises(ValueError):
        wacz.members(lambda at, n: b"no zip at all"[at : at + n], 13)


def test_zip64_end_records():
    """An archive whose directory lies behind the ZIP64 end, as one of over 65535 members or 4 GB has."""
    import struct

    raw = wacz._Archive().bytes()
    end = raw.rindex(b"PK\5\6")
    count, length, offset = struct.unpack_from("<HII", raw, end + 10)
    far = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, count, count, length, offset) + struct.pack("<4sIQI", b"PK\6\7", 0, end, 1)
    near = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"PK\5"
    big = raw[:end] + far + near
    assert wacz.members(lambda at, n: big[at : at + n], len(big)) == wacz.members(lambda at, n: raw[at : at + n], len(raw))


def test_index_lines_are_cdxj():
    line = wacz.cdxj("http://www.Example.com/A b?x=1", "ab" * 20, "response", 7, 9)
    key, time, fields = line.split(" ", 2)
    assert key == "com,example,www)/a%20b?x=1" and time == "20240101000000"
    assert {"url", "digest", "filename", "offset", "length"} <= set(json.loads(fields))


def test_archives_of_other_software(spark, tmp_path):
    """Any member names, gzipped and plain records, a gzipped index, a member without an index, records that are no captures."""
    import gzip
    import zipfile

    def warc(kind, more, block):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{kind}>\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    digest = base64.b32encode(hashlib.sha1(b"one").digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    one = gzip.compress(warc("response", f"WARC-Target-URI: http://a.org/\r\nWARC-Payload-Digest: sha1:{digest}\r\n", http + b"one"))
    info = gzip.compress(warc("warcinfo", "", b"software: other"))
    plain = warc("request", "", b"GET / HTTP/1.1\r\n\r\n") + warc("response", "WARC-Target-URI: http://b.org/\r\n", http + b"two") + warc("resource", "WARC-Target-URI: http://c.org/\r\n", b"three")
    line = json.dumps({"url": "http://a.org/", "digest": f"sha1:{digest}", "filename": "rec-1.warc.gz", "offset": str(len(info)), "length": len(one)})
    index = gzip.compress(b"!meta 0 {}\n") + gzip.compress(f"org,a)/ 20200102030405 {line}\n".encode())
    with zipfile.ZipFile(tmp_path / "other.wacz", "w", zipfile.ZIP_STORED) as file:
        for name, raw in (("pages/pages.jsonl", b"{}"), ("archive/rec-1.warc.gz", info + one), ("indexes/index.cdx.gz", index), ("archive/rec-2.warc", plain), ("archive/rec-3.warc.gz", info + one + one)):
            file.writestr(name, raw)
    rows = wacz.archive_records(frame(spark, [(f"file://{tmp_path}/other.wacz",)], "path string")).collect()
    assert sorted((r.url, r.payload, r.record_type) for r in rows) == [
        *[("http://a.org/", b"one", "response")] * 3, ("http://b.org/", b"two", "response"), ("http://c.org/", b"three", "resource")
    ]
    assert all(r.page_id is None and r.payload_digest == hashlib.sha1(r.payload).hexdigest() and r.payload_bytes == len(r.payload) for r in rows)
    assert wacz._opened("dbfs:/a/b")[1] == "/dbfs/a/b"


def test_broken_payload_is_found():
    raw = wacz.record(1, "http://a/", b"payload", hashlib.sha1(b"payload").hexdigest(), 7, None)
    with pytest.raises(ValueError):
        wacz.parsed(raw.replace(b"payload", b"pAyload"))


# --- 8: mixing -----------------------------------------------------------------


def brute_mixture(rows, weights, epochs, share, seed):
    tokens = collections.Counter()
    for r in rows:
        tokens[r["leaf"]] += r["n"]
    leaves = {k: v for k, v in tokens.items() if v}

    def divide(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        names = sorted({k[depth] for k in leaves if k[:depth] == prefix})
        caps = {n: epochs * sum(v for k, v in leaves.items() if k[: depth + 1] == (*prefix, n)) for n in names}
        w = {n: weights.get(mixing.LEVELS[depth], {}).get(n, 1) for n in names}
        full = set()
        while True:
            left, mass = budget - sum(caps[n] for n in full), sum(w[n] for n in names if n not in full)
            more = {n for n in names if n not in full and w[n] and caps[n] * mass <= left * w[n]}
            if not more:
                break
            full |= more
        out = {}
        for n in names:
            if w[n]:
                out |= divide((*prefix, n), caps[n] if n in full else left * w[n] // mass)
        return out

    budget = sum(leaves.values()) * share[0] // share[1]
    taken = collections.Counter()
    for leaf, got in divide((), budget).items():
        whole, rest = divmod(got, leaves[leaf])
        own = [r for r in rows if r["leaf"] == leaf]
        key = lambda r: hashlib.md5(f"{seed}:{whole}:{'' if r['id'] is None else r['id']}".encode()).hexdigest()  # noqa: B023, E731
        for r in own:
            upto = sum(x["n"] for x in own if key(x) <= key(r))
            for e in range(whole + (upto <= rest)):
                taken[r["id"], r["text"], e] += 1
    return taken


@pytest.mark.parametrize("share", [(1, 1), (1, 3), (9, 2)])
def test_mixing_matches_brute_force(spark, share):
    rng = random.Random(7)
    sources = [None, "src0", "src1", "src11", "src12", "elsewhere"]
    docs = [(i, None if i == 5 else "w " * rng.choice([0, 1, 3, 10, 40, 200]), rng.choice([None, "en", "fr", "de"]), rng.choice(sources)) for i in range(300)]
    docs += [docs[10], docs[10], (None, "w w w", "en", "src0"), (None, "w w", "en", "src0")]
    weights = {"_domain": {"web": 5, "library": 1}, "_lang": {"en": 3, "de": 0}, "_source": {"src1": 4}}

    def domain(s):
        return "web" if s in ("src0", "src1") else "library" if s in ("src11", "src12") else "other"

    rows = [{"id": i, "text": t, "n": len((t or "").split()), "leaf": (domain(s), lang or "", s or "")} for i, t, lang, s in docs]
    table = frame(spark, docs, "doc_id bigint, text string, lang string, source string").withColumn("epoch", F.lit("clash")).withColumn("key", F.lit(1))
    got = collections.Counter((r.doc_id, r.text, r.epoch) for r in mixing.mixed(table, weights=weights, epochs=3, share=share, seed=9).collect())
    assert got == brute_mixture(rows, weights, 3, share, 9)


def test_mixing_on_edges(edge_docs, no_docs):
    assert mixing.mixed(no_docs).count() == 0
    assert mixing.mixed(edge_docs).count() > 0
    plan = mixing.mixed(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- pipeline ------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, before, sf)
        assert after.columns == list(corpus_pipeline.COLUMNS), name
        after = spark.createDataFrame(after.collect(), docs.schema)
        old, new = {r.doc_id for r in before.collect()}, {r.doc_id for r in after.collect()}
        assert new <= old and len(new) > 0.3 * len(old)
        if name.startswith("quality"):
            clean = [i for i in old if labels.get(i) == 1]
            assert sum(i in new for i in clean) >= 0.98 * len(clean)
            assert sum(i in new for i in old if labels.get(i) == 0) <= 0.1 * sum(labels.get(i) == 0 for i in old)
        before = after
    last = corpus_pipeline.STAGES[4][1](spark, before, sf)
    theirs = Tokenizer.from_file(VOCABULARY)
    for r in last.collect()[:20]:
        assert r.ids == theirs.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_pipeline_run_matches_brute_force(spark, tmp_path):
    """All five stages on a small corpus: trees applied one by one, repeats, similarities of all pairs, the mixture, the tokenizers library."""
    import corpus_pipeline

    rng = random.Random(12)
    fresh = iter(range(10**9))
    prose = lambda n: [f"word{next(fresh)}" for _ in range(n)]
    passage, base, texts = prose(60), prose(190), []
    for i in range(40):
        texts.append(" ".join([*prose(rng.randint(5, 60)), "\n", *(passage if i % 9 == 4 else []), "\n", *prose(10)]))
        texts.append(" ".join(rng.choice("#$%&*") * rng.randint(1, 9) for _ in range(rng.randint(5, 60))))
    near = [base.copy() for _ in range(4)]
    for n, words in enumerate(near):  # a changed word after each 47: no run of 50 words is equal, most shingles are
        for at in range(47, 190, 48):
            words[at] = f"other{n}x{at}"
    texts += [" ".join(w) for w in near] + [texts[0], texts[2], " ".join(passage), None, "", "\n \n"]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["src0", "src11", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, "an unnamed text", "en", "src0", 15)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    labels = [(i, int(i % 2 == 0)) for i in range(80)]
    folder = str(tmp_path)
    docs = frame(spark, rows, schema)
    docs.write.parquet(f"{folder}/documents.parquet")
    frame(spark, labels, "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
    got = collections.Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars, tuple(r.ids), r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect())

    chosen = [(texts[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    x, y = np.array([quality.statistics(t) for t, _ in chosen]), np.array([y for _, y in chosen], float)
    order = np.lexsort((*x.T, y))
    trees = quality.Trees().fit(x[order], y[order])
    left = [r for r in rows if trees.score(np.array([quality.statistics(r[1])]))[0] >= 0.5]
    left.sort(key=lambda r: (r[0] is None, r[0] or 0))
    cut = []
    for r, gone in zip(left, brute_repeats([(r[0], r[1]) for r in left], 50)):
        if not gone:
            cut.append(r)
        elif kept := [w for k, w in enumerate(r[1].split()) if k not in gone]:
            cut.append((*r[:4], kept))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((r[4] if isinstance(r[4], list) else (r[1] or "").split()) for r in cut)]
    label = list(range(len(cut)))
    for i in range(len(cut)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                label = [label[j] if k == label[i] else k for k in label]
    ids = [min((cut[k][0] for k in range(len(cut)) if label[k] == label[i] and cut[k][0] is not None), default=None) for i in range(len(cut))]
    single = [(r, s) for r, s, i in zip(cut, sets, ids) if r[0] is None or r[0] == i]
    told = {r[0]: r for r, _ in single}
    assert {d for d, *_ in got} <= set(told) and len(single) < len(cut) < len(left) < len(rows)
    theirs = Tokenizer.from_file(VOCABULARY)
    texts_out = {}
    for d, text, lang, source, n, tokens, count in got:
        r = told[d]
        changed = isinstance(r[4], list)
        assert (lang, source) == r[2:4] and (text or "").split() == (r[4] if changed else (r[1] or "").split())
        assert n == (len(text) if changed else r[4]) and (changed or text == r[1])
        assert list(tokens) == theirs.encode(text or "", add_special_tokens=False).ids and count == len(tokens)
        texts_out[d] = text
    domain = lambda s: "web" if s == "src0" else "library" if s == "src11" else "other"
    words = lambda r: len(r[4]) if isinstance(r[4], list) else len((r[1] or "").split())
    mixture = [{"id": r[0], "text": None, "n": words(r), "leaf": (domain(r[3]), r[2] or "", r[3] or "")} for r, _ in single]
    want = collections.Counter()
    for (d, _, _epoch), c in brute_mixture(mixture, mixing.WEIGHTS, mixing.EPOCHS, mixing.SHARE, mixing.SEED).items():
        want[d] += c
    mine = collections.Counter()
    for (d, *_), c in got.items():
        mine[d] += c
    assert mine == want

    frame(spark, [], schema).write.parquet(f"{folder}/none/documents.parquet")
    frame(spark, [], "doc_id bigint, quality int").write.parquet(f"{folder}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
