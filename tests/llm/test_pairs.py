"""The shingle join, components, suffix sorting and substring removal against plain versions."""

import hashlib
import random

import numpy as np
import pytest

from roadgeo.llm import anchors, shingle_join, substring_dedup, suffix_array
from roadgeo.llm.components import components
from roadgeo.llm.suffix_array import suffix_ranks


def grown(seed, n, words=150, families=6):
    """Texts in families: a base, copies with few and with many words changed, and passages that families share."""
    r = random.Random(seed)
    bases = [[f"w{r.randrange(5000)}" for _ in range(words)] for _ in range(families)]
    passage = [f"p{i}" for i in range(60)]
    out = []
    for i in range(n):
        text = list(bases[i % families])
        for _ in range(r.choice((0, 0, 1, 2, 3, 5, 8))):
            text[r.randrange(len(text))] = f"x{r.randrange(10**6)}"
        if i % 5 == 0:
            at = r.randrange(words)
            text[at:at] = passage
        out.append(" ".join(text))
    return out


def sets(text, words):
    found = (text or "").encode().lower().split()
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def brute_links(rows, words, of_union):
    """Component of each id."""
    comp = {d: d for d, _ in rows if d is not None}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    known = [(d, s) for d, t in rows if d is not None and (s := sets(t, words))]
    for i, (a, s) in enumerate(known):
        for b, u in known[:i]:
            if 100 * len(s & u) >= of_union * len(s | u):
                x, y = sorted((top(a), top(b)))
                comp[y] = x
    return {d: top(d) for d in comp}


@pytest.mark.parametrize("words,of_union,chunk", [(3, 90, 2048), (3, 90, 4), (5, 80, 3)])
def test_shingle_join(spark, awkward, monkeypatch, words, of_union, chunk):
    monkeypatch.setattr(shingle_join, "CHUNK", chunk)
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()] + list(enumerate(grown(words, 70), 100))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = shingle_join.link(docs, words, of_union).collect()
    want = brute_links(rows, words, of_union)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(d, want.get(d)) for d, _ in rows}
    assert sorted((r.doc_id or 0, r.n_shingles) for r in got) == sorted((d or 0, len(sets(t, words))) for d, t in rows)


def test_shingle_join_of_nothing(spark, awkward):
    assert shingle_join.link(awkward.limit(0)).collect() == []


def test_trees_lose_no_pair():
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 62, 200, dtype=np.uint64)
    rows = [np.unique(np.concatenate([base[: r.integers(150, 200)], r.integers(0, 1 << 62, r.integers(0, 40), dtype=np.uint64)])) for _ in range(150)]
    rows.sort(key=len)
    maps, sizes = shingle_join.same_length([shingle_join.bitmap(x) for x in rows]), np.array([len(x) for x in rows])
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if 100 * len(np.intersect1d(rows[i], rows[j])) >= 90 * len(np.union1d(rows[i], rows[j]))}
    own = np.arange(150)
    tree = shingle_join.Tree(maps, sizes, own)
    i, j = shingle_join.joined(tree, tree, True)
    got = set(zip(i.tolist(), j.tolist()))
    assert want and want <= got and all(a < b for a, b in got) and len(got) < 150 * 149 / 2
    half = [shingle_join.Tree(maps[k::2], sizes[k::2], own[k::2]) for k in (0, 1)]
    i, j = shingle_join.joined(*half, False)
    assert {(a, b) for a, b in want if a % 2 != b % 2} <= {tuple(sorted((2 * a, 2 * b + 1))) for a, b in zip(i.tolist(), j.tolist())}


def test_trees_pass_over_what_is_connected():
    r = np.random.default_rng(8)
    base = r.integers(0, 1 << 62, 300, dtype=np.uint64)
    rows = [np.unique(np.concatenate([base[: r.integers(270, 300)], r.integers(0, 1 << 62, 4, dtype=np.uint64)])) for _ in range(200)]
    maps, sizes = shingle_join.same_length([shingle_join.folded(shingle_join.bitmap(x)) for x in rows]), np.array([len(x) for x in rows])
    for component in (np.zeros(200, int), np.arange(200) // 70, r.integers(0, 9, 200)):
        tree = shingle_join.Tree(maps, sizes, component)
        got = set(zip(*(x.tolist() for x in shingle_join.joined(tree, tree, True))))
        want = {(i, j) for i in range(200) for j in range(i + 1, 200) if component[i] != component[j] and 100 * len(np.intersect1d(rows[i], rows[j])) >= 90 * len(np.union1d(rows[i], rows[j]))}
        assert want <= got and all(component[i] != component[j] for i, j in got) and bool(want) == bool(component.any())


def test_bitmaps_tell_what_differs_however_much_is_shared():
    """Near copies a little too far apart: few of all pairs may be left for the comparison of whole sets, and no pair within the threshold is lost."""
    r = np.random.default_rng(3)
    for of_union, base, changed in ((90, 700, 60), (80, 700, 130), (80, 1000, 190)):
        shared = r.integers(0, 1 << 62, base, dtype=np.uint64)
        rows = [np.unique(np.concatenate([r.permutation(shared)[changed:], r.integers(0, 1 << 62, changed, dtype=np.uint64)])) for _ in range(120)]
        rows += [np.unique(np.append(rows[k][3:], r.integers(0, 1 << 62, 3, dtype=np.uint64))) for k in range(40)]
        maps, sizes = shingle_join.same_length([shingle_join.folded(shingle_join.bitmap(x)) for x in rows]), np.array([len(x) for x in rows])
        tree = shingle_join.Tree(maps, sizes, np.arange(len(rows)))
        got = set(zip(*(x.tolist() for x in shingle_join.joined(tree, tree, True, of_union))))
        every = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows))]
        want = {(i, j) for i, j in every if 100 * len(np.intersect1d(rows[i], rows[j])) >= of_union * len(np.union1d(rows[i], rows[j]))}
        assert len(want) >= 40 and want <= got and len(got) < 2 * len(want)


def test_frequent_passages_and_empty_parts_bring_no_classes_together(spark, monkeypatch):
    """Texts that share a passage, but are far from linked, meet in hardly any bucket; copies near the threshold still do."""
    r = random.Random(11)
    passage = [f"p{i}" for i in range(40)]
    texts = [passage + [f"w{r.randrange(10**9)}" for _ in range(r.randrange(180, 420))] for _ in range(150)]
    alone = len(texts)
    for k in range(0, 60, 2):
        # A word replaced changes five shingles; some words left out at the end make the sizes differ.
        copy = list(texts[k])
        for at in r.sample(range(40, len(copy)), max(1, len(copy) // 50 + r.randrange(-1, 2))):
            copy[at] = f"x{r.randrange(10**9)}"
        texts.append(copy[: len(copy) - r.randrange(0, 9)])
    rows = list(enumerate(map(" ".join, texts)))
    members, buckets = [], shingle_join._buckets
    monkeypatch.setattr(shingle_join, "_buckets", lambda keyed: members.append(buckets(keyed)) or members[-1])
    removed = []
    monkeypatch.setattr(shingle_join, "discard", lambda *stored: removed.extend(stored))
    got = {x.doc_id: x.component_id for x in shingle_join.link(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 80).collect()}
    want = brute_links(rows, 5, 80)
    assert got == want and 10 < sum(want[d] != d for d in want) < len(texts) - alone + 1
    lone = [d for d in range(60, alone)]
    assert sum(m.where(m["rep"].isin(lone)).count() for m in members) < len(lone)


def test_components(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    got = components(spark.createDataFrame([*path, *star, (7, 7), (203, 201), (202, 203)], "a bigint, b bigint"))
    assert {tuple(r) for r in got.collect()} == {*((i, 0) for i in range(41)), *((100 + i, 100) for i in range(60)), (201, 201), (202, 201), (203, 201)}


@pytest.mark.parametrize("n,letters", [(40, 2), (61, 3), (90, 1), (3, 2)])
def test_suffix_ranks(spark, n, letters, monkeypatch):
    monkeypatch.setattr(suffix_array, "BLOCK", 16)
    c = np.random.default_rng(n).integers(1, letters + 1, n).tolist()
    for base in (4, 1000):
        got = suffix_ranks(spark.createDataFrame(list(enumerate(c)), "i bigint, c bigint"), n, base).collect()
        order = [r.i for r in sorted(got, key=lambda r: r["rank"])]
        assert order == sorted(range(n), key=lambda i: c[i:]) and len({r["rank"] for r in got}) == n


@pytest.mark.parametrize("slices,at_once", [(7, 3), (1, 1), (4, 1000)])
def test_equal_neighbours(spark, slices, at_once):
    """Suffixes of one prefix find each other in one task and in several, whether few or most of all rows."""
    r = random.Random(slices)
    prefixes = [b"common"] * 60 + [bytes([r.randrange(40)]) * r.randrange(1, 4) for _ in range(60)] + [b"", b"z"]
    rows = [(bytes([r.randrange(5)]), k, p) for k, p in enumerate(prefixes)]
    got = suffix_array.equal_neighbours(spark.createDataFrame(rows, "piece binary, k int, prefix binary"), slices, at_once, "test-order").collect()
    assert {(bytes(x.piece), x.k) for x in got} == {(piece, k) for piece, k, p in rows if prefixes.count(p) > 1}


def test_anchors_give_each_window_its_smallest_gram(monkeypatch):
    r = random.Random(5)
    for letters in ("ab", "a", "abcdefgh"):
        raw = "".join(r.choice(letters) for _ in range(3000)).encode()
        whole = anchors.anchors(raw)
        h = anchors.gram_hashes(np.frombuffer(raw, np.uint8)) >> np.uint64(24)
        for s in range(len(raw) - anchors.WINDOW + 1):
            k = int(np.searchsorted(whole[3], s))
            assert whole[2][k] <= s <= whole[3][k] and whole[0][k] == s + int(np.argmin(h[s : s + anchors.STEPS]))
        monkeypatch.setattr(anchors, "PIECE", 700)
        assert all((x == y).all() for x, y in zip(whole, anchors.anchors(raw)))
        monkeypatch.undo()


def brute_removed(texts):
    places = {}
    raws = [(t or "").encode() for t in texts]
    for k, raw in enumerate(raws):
        for s in range(len(raw) - 199):
            places.setdefault(raw[s : s + 200], []).append((k, s))
    cover = [np.zeros(len(raw), bool) for raw in raws]
    for at in places.values():
        if len(at) > 1:
            for k, s in at:
                cover[k][s : s + 200] = True
    out = []
    for raw, c in zip(raws, cover):
        spans = int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())
        out.append((len(raw), int(c.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~c])).hexdigest()))
    return out


@pytest.mark.parametrize("base,neighbours", [(1 << 18, 1 << 16), (64, 8)])
def test_substring_dedup(spark, awkward, monkeypatch, base, neighbours):
    monkeypatch.setattr(substring_dedup, "NEIGHBOURS", neighbours)
    r = random.Random(6)
    noise = lambda n: "".join(r.choice("abcdefghij é") for _ in range(n))
    shared, long = noise(150) + "|" + noise(140), noise(900)
    made = [noise(200) + shared + noise(50), shared[:-1], shared, long + noise(30), noise(10) + long[1:] + "!", long[:199], long[:200], noise(700), "ab" * 300, "y" * 250, "y" * 201, long]
    made += [noise(r.randrange(0, 300)) + shared + noise(r.randrange(0, 300)) for _ in range(6)] + grown(9, 8, 80, 2)
    rows = [(d, t) for d, t in awkward.select("doc_id", "text").collect() if d != 5] + list(enumerate(made, 100))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = substring_dedup.dedup(docs, base).collect()
    want = brute_removed([t for _, t in rows])
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got), key=key) == sorted(((d, *w) for (d, _), w in zip(rows, want)), key=key)


def test_substring_dedup_of_nothing(spark, awkward):
    assert substring_dedup.dedup(awkward.limit(0)).collect() == []


def test_more_suffixes_take_no_more_rounds(spark, monkeypatch):
    """Suffixes that fit no single task are dealt out and sorted in as many steps as few ones; each task reads few of them."""
    r = random.Random(21)
    shared = "".join(r.choice("abcdefghij ") for _ in range(4000))
    texts = [f"{k} {shared[k * 10 :]}{k}" for k in range(12)] + ["line of a log that repeats; " * 80]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    steps = []
    for module in (substring_dedup, suffix_array):
        monkeypatch.setattr(module, "staged", lambda df, name, f=module.staged: steps.append(name) or f(df, name))
    results, counts = [], []
    for base in (1 << 18, 16):
        steps.clear()
        results.append(sorted(tuple(x)[:5] for x in substring_dedup.dedup(docs, base).collect()))
        counts.append(len(steps))
    assert results[0] == results[1] == [(d, *w) for d, w in enumerate(brute_removed(texts))]
    assert counts[0] == counts[1]


def test_neighbouring_suffixes_decide(spark):
    """Phrases that occur again, but never over 200 bytes, are not marked; a longer run of them is, whatever stands before and after it."""
    r = random.Random(8)
    noise = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    short, long = [noise(190) for _ in range(40)], noise(2000)
    made = [noise(300) + x + noise(300) for x in short * 2] + [noise(100) + long + noise(400), noise(350) + long + noise(90)]
    docs = spark.createDataFrame(list(enumerate(made)), "doc bigint, text string").selectExpr("doc", "doc as row", "text")
    found = []
    marks = substring_dedup.suffix_marks
    try:
        substring_dedup.suffix_marks = lambda kept, base: found.append((kept, marks(kept, base))) or found[0][1]
        got = {g.doc_id: g for g in substring_dedup.dedup(docs.select(docs["doc"].alias("doc_id"), "text")).collect()}
    finally:
        substring_dedup.suffix_marks = marks
    again = found[0][0].selectExpr("doc", "inline(anchors)").where("again and gap > 0 and doc < 80").count()
    by_order = found[0][1].collect()
    assert again > 0 and {m.doc for m in by_order} == {80, 81}
    for m in by_order:
        at = made[m.doc].index(long)
        assert at <= m.start and m.end <= at + 2000 and m.end - m.start > 1500
    assert all(got[d].n_removed == (0 if d < 80 else 2000) for d in got)
