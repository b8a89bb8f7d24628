"""The manifest against a plain recursion."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from roadgeo.llm import merkle, queries

NAMES = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[1], row[2], row[3], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Levels from the lowest to the last node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 3 * 3
        out.append((level[run:at], level[at + 1 : run + 3]))
        at //= 3
    return out


def plain(rows):
    """Result rows for rows of (doc_id, source, lang, n_chars, text)."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r, r[4]) for r in sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for i, s in enumerate(order):
        members = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        for at, r in enumerate(members):
            steps = path(trees[s], at) + path(top, i)
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            text = r[4].replace("\n", "") if even and r[4] is not None else r[4]
            folded = leaf(r, text)
            for before, after in steps:
                folded = h(*before, folded, *after)
            root = top[-1][0]
            out.append((r[0], s, leaf(r, r[4]), trees[s][-1][0], root, h(*(x for before, after in steps for x in before + after)), folded, folded == root))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    clash = docs.selectExpr("*", "1 as pos", "2 as n", "'x' as grp", "'y' as digest", "3 as tampered", "4 as row", "'z' as leaf", "'w' as root", "5 as steps")
    tampers = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return sorted((tuple(r) for r in merkle.manifest(clash, tampers, F.replace("text", F.lit("\n"), F.lit(""))).collect()), key=str)


AWKWARD = [
    (None, None, None, None, None), (None, "a", "en", 3, "x\ny"), (1, "a", "", 0, ""), (1, "a", "", 0, ""), (2, "é", "de", 2, "ü\n"), (2, "z", None, -1, "\n\n"),
    (3, "", "en", 5, "one\nmore"), (4, None, "en", 5, "lines\n" * 9000), (5, "a", "en", None, None), (-7, "a", "en", 1, "q"),
]


def test_awkward_rows(spark):
    assert run(spark, AWKWARD) == plain(AWKWARD)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 27, 28, 82, 800])
def test_sizes(spark, n):
    rows = [(i * 5 - 9, f"s{i % 40}" if i % 3 else "hot", "en", i, f"line {i}\nend") for i in range(n)]
    assert run(spark, rows) == plain(rows)


def test_equal_rows_in_numbers(spark):
    rows = [(6, "hot", "en", 1, "same\ntext")] * 300 + [(i, f"s{i}", "en", 1, "t") for i in range(30)]
    assert run(spark, rows) == plain(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_tampering_is_seen_where_lines_end(spark):
    rows = queries.op13_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (texts[r["doc_id"]] or "")
        assert r["verified"] != changed
    assert 0 < sum(r["verified"] for r in rows) < len(rows)


def test_only_every_third_level_is_stored(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(merkle, "staged", lambda df, name, keep=merkle.staged: stored.append(name) or keep(df, name))
    run(spark, [(i, "s", "en", i, "t") for i in range(100)])  # 5 levels of nodes above the leaves
    assert stored.count("merkle-level") == 2
