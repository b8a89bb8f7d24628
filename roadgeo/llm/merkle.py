"""Merkle manifest of a dataset: checkpoint and recompute.

A row is a leaf. The leaves of a source, in the order of doc_id, form a tree in which up to FANOUT consecutive nodes become
one; the sources' last nodes, in the order of the source, form another over them, and its last node is the root.

Nodes lie in aligned subtrees of FANOUT ** STRIDE. Going up, a subtree is one row: its lowest nodes come in, its top node
goes out, and only that is written; so of all levels only every STRIDE-th is stored. Going down, each subtree's missing
nodes are made once more from its stored lowest ones, the siblings that its members need are handed out, and the rest is
forgotten. A subtree's members get their path above it from the row of its top node, so no document meets more than
its own subtree. A source of any size is cut into subtrees; its order comes from a range partitioning.

Cases. Null columns have a mark of their own in the leaf, so they differ from empty strings. A null source is a source and the
first one. A null doc_id comes before all others of its source and is never tampered with. Rows of one id are ordered by
their leaves; equal rows have equal leaves, and which of them comes first tells nothing apart but their proofs. A text
without line ends is the same after tampering and is verified. An empty table has no rows and no root. Columns other than the
five hashed ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgeo.llm.common import by_batch, discard, staged
from roadgeo.operators.numbering import numbered

FANOUT = 3
#: Levels from one stored level to the next: subtrees of 27 nodes.
STRIDE = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

_STEP = "struct<before:string,after:string>"
_PATH = f"grp string, pos bigint, steps array<{_STEP}>, subroot string, root string"
_RESULT = "doc_id bigint, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _field(column: F.Column) -> F.Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**instead: F.Column) -> F.Column:
    """The digest of a row; `instead` names columns to be replaced."""
    return F.sha2(F.concat(*(_field(instead.get(c, F.col(c))) for c in FIELDS)).cast("binary"), 256)


def node(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def climb(lowest: list[str], whole: bool) -> Iterator[list[str]]:
    """The levels of a subtree, lowest first. `whole`: it holds all of its tree and ends when one node is left;
    otherwise it rises by STRIDE levels, whatever its width."""
    yield lowest
    level, risen = lowest, 0
    while len(level) > 1 if whole else risen < STRIDE:
        level = [node(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
        risen += 1
        yield level


def steps(levels: list[list[str]], at: int) -> list[dict[str, str]]:
    """What stands before and after the node's ancestors in their runs, for a node of the lowest level."""
    out = []
    for level in levels[:-1]:
        first = at - at % FANOUT
        out.append({"before": "".join(level[first:at]), "after": "".join(level[at + 1 : first + FANOUT])})
        at //= FANOUT
    return out


def fold(digest: str, path: list[dict[str, str]]) -> str:
    """The root that a leaf and its path lead to."""
    for step in path:
        digest = hashlib.sha256(f"{step['before']}{digest}{step['after']}".encode()).hexdigest()
    return digest


def _subtrees(nodes: DataFrame, members: list[str]) -> DataFrame:
    """A row per subtree: grp, block, n, and its members in order, each with the columns named."""
    block = F.floor(F.col("pos") / FANOUT**STRIDE).cast("bigint")
    listed = F.sort_array(F.collect_list(F.struct("pos", *members)))
    return nodes.withColumn("block", block).groupBy("grp", "block").agg(F.max("n").alias("n"), listed.alias("members"))


def _tops(grps, blocks, ns, members) -> Iterator[tuple]:
    width = FANOUT**STRIDE
    for grp, block, n, inside in zip(grps, blocks, ns, members):
        *_, (top,) = climb([m["digest"] for m in inside], n <= width)
        yield grp, block, -(-n // width), top


def _rise(nodes: DataFrame) -> list[DataFrame]:
    """The stored levels, from `nodes` (grp, pos, n, digest) to the one that holds a single node of each group."""
    stored, most = [nodes], nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        tops = by_batch(_subtrees(stored[-1], ["digest"]), _tops, "grp string, pos bigint, n bigint, digest string", at_once=500)
        stored.append(staged(tops, "merkle-level"))
        most = -(-most // FANOUT**STRIDE)
    return stored


def _with_paths(nodes: DataFrame, members: list[str], above: DataFrame) -> DataFrame:
    """Subtrees with the path above them."""
    up = above.select(F.col("grp").alias("up_grp"), F.col("pos").alias("up_pos"), "steps", "subroot", "root")
    found = _subtrees(nodes, members).join(up, F.col("grp").eqNullSafe(F.col("up_grp")) & (F.col("block") == F.col("up_pos")))
    return found.drop("up_grp", "up_pos")


def _down(grps, blocks, ns, members, paths, subroots, roots) -> Iterator[tuple]:
    for grp, block, n, inside, path, subroot, root in zip(grps, blocks, ns, members, paths, subroots, roots):
        levels = list(climb([m["digest"] for m in inside], n <= FANOUT**STRIDE))
        for at, m in enumerate(inside):
            yield grp, m["pos"], steps(levels, at) + path, subroot, root


def _descend(stored: list[DataFrame], above: DataFrame) -> DataFrame:
    """The paths of the nodes of the lowest of the levels; `above` has the path of each group's last node at place 0."""
    for nodes in reversed(stored):
        upper, above = above, staged(by_batch(_with_paths(nodes, ["digest"], above), _down, _PATH, at_once=500), "merkle-paths")
        discard(upper)
    return above


def _proofs(grps, blocks, ns, members, paths, subroots, roots) -> Iterator[tuple]:
    for source, block, n, inside, path, subroot, root in zip(grps, blocks, ns, members, paths, subroots, roots):
        levels = list(climb([m["digest"] for m in inside], n <= FANOUT**STRIDE))
        for at, m in enumerate(inside):
            whole = steps(levels, at) + path
            folded = fold(m["digest"] if m["tampered"] is None else m["tampered"], whole)
            proof = node([s["before"] + s["after"] for s in whole])
            yield m["doc_id"], source, m["digest"], subroot, root, proof, folded, folded == root


def manifest(docs: DataFrame, tampers: F.Column, tampered_text: F.Column) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified for each row. Rows for which `tampers` is
    true are folded from the leaf that `tampered_text` gives; all else is of the rows as they are."""
    other = F.when(tampers, leaf(text=tampered_text))
    hashed = docs.select("doc_id", F.col("source").alias("grp"), leaf().alias("digest"), other.alias("tampered"))
    leaves = staged(hashed.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    counts = leaves.groupBy(F.col("grp").alias("of")).agg(F.count("*").alias("n"))
    placed = numbered(leaves, "grp", ["doc_id", "digest", "row"], "pos")
    lowest = staged(placed.join(counts, F.col("grp").eqNullSafe(F.col("of"))).drop("of", "row"), "merkle-placed")
    trees = _rise(lowest.select("grp", "pos", "n", "digest"))

    last = trees[-1].select(F.col("grp").alias("source"), F.col("digest"), F.lit("").alias("grp"))
    over = numbered(last, "grp", ["source"], "pos").withColumn("n", F.lit(last.count()).cast("bigint"))
    subroots = staged(over, "merkle-subroots")
    upper = _rise(subroots.select("grp", "pos", "n", "digest"))
    start = upper[-1].select("grp", "pos", F.array().cast(f"array<{_STEP}>").alias("steps"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    paths = _descend(upper, start).select(F.col("pos").alias("place"), "steps", "root")
    above = subroots.join(paths, F.col("pos") == F.col("place")).select(
        F.col("source").alias("grp"), F.lit(0).cast("bigint").alias("pos"), "steps", F.col("digest").alias("subroot"), "root")
    above = _descend(trees[1:], above)
    discard(leaves, *trees[1:], *upper[1:])
    return by_batch(_with_paths(lowest, ["doc_id", "digest", "tampered"], above), _proofs, _RESULT, at_once=500)
