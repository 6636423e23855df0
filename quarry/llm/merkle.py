"""Merkle manifest of a dataset: distributed blocks of leaves under a small broadcast upper tree.

A row is a leaf, the SHA-256 of its fields. A source's leaves in order of their
ids form a tree in which every RUN consecutive nodes become one; the sources'
roots in order of their names form the tree above them. A range partitioning
over source and id ranks the leaves, so that a hot source is dealt to many
tasks. Blocks of RUN ** LEVELS leaves are folded to one digest each, at once;
the driver builds the tree over the blocks and broadcasts it, and executors
finish each row's proof and its fold from the block and the suffix path above
it. More than TOP blocks, or sources, are folded by blocks in their turn, and
their suffix paths are joined instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored

#: Consecutive nodes that become one.
RUN = 16
#: Levels of a block: RUN ** LEVELS leaves.
LEVELS = 3
#: Blocks that the driver gathers and broadcasts as a tree, at most: some 150 bytes each.
TOP = 65_536
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64
_PATH = "array<struct<place:int,run:string>>"


def leaf(*fields: Column | str) -> Column:
    """The digest of fields: each `-` if null, else its UTF-8 byte count, `:` and its text."""
    texts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def digest(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def grown(nodes: str, height: int | None = None) -> list[str]:
    """The levels over the joined digests of nodes: until one node remains, or so many as height says."""
    levels = [nodes]
    while len(levels) <= height if height is not None else len(levels[-1]) > _HEX:
        last = levels[-1]
        levels.append("".join(digest(last[at : at + RUN * _HEX]) for at in range(0, len(last), RUN * _HEX)))
    return levels


def path_of(levels: list[str], place: int) -> list[tuple[int, str]]:
    """(place in its run, run) of a node and of those above it, but for the last."""
    out = []
    for level in levels[:-1]:
        at = place // RUN * RUN * _HEX
        out.append((place % RUN, level[at : at + RUN * _HEX]))
        place //= RUN
    return out


def siblings(place: int, run: str) -> str:
    return run[: place * _HEX] + run[(place + 1) * _HEX :]


def folded(node: str, path: list[tuple[int, str]]) -> str:
    """The root over a node, from its own digest and the siblings on its path."""
    for place, run in path:
        node = digest(run[: place * _HEX] + node + run[(place + 1) * _HEX :])
    return node


def _height(rows: int) -> int | None:
    """Levels of a block of a group with so many nodes; None: to the single node that remains."""
    return LEVELS if rows > RUN**LEVELS else None


def _ranked(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """rows with at, the place in their group by the columns of order, and n, the group's rows."""
    sorted_ = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = stored(sorted_.withColumn("mark", F.monotonically_increasing_id()), name)
    # a row for each partition and group in it
    pieces = placed.groupBy(F.shiftright("mark", 33).alias("piece"), F.col(group).alias("g")).agg(F.min("mark").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("g")
    before = F.coalesce(F.sum("rows").over(whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    offsets = pieces.select("piece", "g", "first", before.alias("before"), F.sum("rows").over(whole).alias("n"))
    joined = placed.join(offsets, (F.shiftright("mark", 33) == F.col("piece")) & F.col(group).eqNullSafe(F.col("g")))
    return joined.withColumn("at", F.col("mark") - F.col("first") + F.col("before")).drop("mark", "piece", "g", "first", "before")


def _heads(nodes: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([grown(x, _height(k))[-1] for x, k in zip(nodes, n)], dtype=object)


def _blocks(rows: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(source, n, block, nodes, digest) of rows (source, n, at, node), nodes as joined hex; extra columns become arrays in the same order."""
    members = F.sort_array(F.collect_list(F.struct("at", "node", *extra)))  # RUN ** LEVELS rows at most
    grouped = rows.groupBy("source", "n", F.expr(f"at div {RUN**LEVELS}").alias("block")).agg(members.alias("m"))
    nodes = F.lower(F.array_join(F.transform("m.node", F.hex), ""))
    listed = grouped.select("source", "n", "block", nodes.alias("nodes"), *[F.col(f"m.{c}").alias(c) for c in extra])
    return listed.withColumn("digest", F.pandas_udf(_heads, "string")("nodes", "n"))


def _gathered(nodes: DataFrame) -> dict[str | None, str]:
    """The joined digests of each source's nodes; at most TOP rows come."""
    found: dict[str | None, list] = {}
    for r in nodes.select("source", "at", "digest").collect():
        found.setdefault(r["source"], []).append((r["at"], r["digest"]))
    return {s: "".join(d for _, d in sorted(x)) for s, x in found.items()}


def _climbed(nodes: DataFrame, top: int) -> DataFrame:
    """(source, at, path, head): the path of each node of (source, n, at, digest) to the head of its source."""
    spark = nodes.sparkSession
    if nodes.count() <= top:
        held = spark.sparkContext.broadcast({s: grown(x) for s, x in _gathered(nodes).items()})

        @F.pandas_udf(f"path {_PATH}, head string")
        def climb(source: pd.Series, at: pd.Series) -> pd.DataFrame:
            return pd.DataFrame({"path": [path_of(held.value[s], int(a)) for s, a in zip(source, at)], "head": [held.value[s][-1] for s in source]})

        return nodes.select("source", "at", climb("source", "at").alias("c")).select("source", "at", "c.path", "c.head")
    if nodes.where("n > 1").isEmpty():
        return nodes.select("source", "at", F.array().cast(_PATH).alias("path"), F.col("digest").alias("head"))
    blocks = stored(_blocks(nodes.withColumn("node", F.unhex("digest")).withColumn("of", F.col("at")), ["of"]), "merkle-upper")
    above = _climbed(blocks.select("source", F.ceil(F.col("n") / RUN**LEVELS).alias("n"), F.col("block").alias("at"), "digest"), top)
    joined = blocks.join(above.select(F.col("source").alias("s"), F.col("at").alias("b"), "path", "head"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for source, n, hexes, places, path, head in zip(pdf["source"], pdf["n"], pdf["nodes"], pdf["of"], pdf["path"], pdf["head"]):
                levels, rest = grown(hexes, _height(n)), [(x["place"], x["run"]) for x in path]
                yield pd.DataFrame({"source": [source] * len(places), "at": places, "path": [path_of(levels, k) + rest for k in range(len(places))], "head": head})

    return joined.select("source", "n", "nodes", "of", "path", "head").mapInPandas(spread, f"source string, at long, path {_PATH}, head string")


def _paths(blocks: DataFrame, top: int) -> DataFrame:
    """blocks with path, subroot and root: the suffix path above each block, through its source's root."""
    nodes = blocks.select("source", F.ceil(F.col("n") / RUN**LEVELS).alias("n"), F.col("block").alias("at"), "digest")
    if nodes.count() <= top:
        trees = {s: grown(x) for s, x in _gathered(nodes).items()}
        names = sorted(trees, key=lambda s: (s is not None, (s or "").encode("utf-8", "surrogatepass")))
        over = grown("".join(trees[s][-1] for s in names))
        held = blocks.sparkSession.sparkContext.broadcast((trees, {s: k for k, s in enumerate(names)}, over))

        @F.pandas_udf(f"path {_PATH}, subroot string, root string")
        def suffix(source: pd.Series, block: pd.Series) -> pd.DataFrame:
            trees, rank, over = held.value
            return pd.DataFrame({"path": [path_of(trees[s], int(b)) + path_of(over, rank[s]) for s, b in zip(source, block)],
                                 "subroot": [trees[s][-1] for s in source], "root": [over[-1]] * len(source)})

        return blocks.withColumn("above", suffix("source", "block")).select(*blocks.columns, "above.*")
    within = stored(_climbed(nodes, top), "merkle-within")
    ranked = _ranked(within.select(F.lit(None).cast("string").alias("all"), F.col("source").alias("name"), F.col("head").alias("digest")).distinct(), "all", ["name"], "merkle-sources")
    ranked = stored(ranked, "merkle-sources")
    over = _climbed(ranked.select(F.col("all").alias("source"), "n", "at", "digest"), top).select(F.col("at").alias("rank"), F.col("path").alias("over"), F.col("head").alias("root"))
    named = ranked.join(over, F.col("at") == F.col("rank")).select("name", "over", "root")
    whole = within.join(named, F.col("source").eqNullSafe(F.col("name"))).select(
        F.col("source").alias("s"), F.col("at").alias("b"), F.concat("path", "over").alias("path"), F.col("head").alias("subroot"), "root")
    return blocks.join(whole, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, source_col: str = "source", id_col: str = "doc_id", altered: Column | None = None, top: int = TOP, proofs: bool = False) -> DataFrame:
    """(id_col, leaf, subroot, root, proof_sha256, folded_root, verified, source, place), one row per row of docs.

    fields are the columns that a leaf holds. altered is the leaf of what is to
    be verified, a Column over docs (null or none: the row's own leaf):
    folded_root is the root over it and the siblings of the row's own leaf, and
    verified says whether it equals root. proofs adds proof, the (place, run)
    of the row's leaf and of each node above it, which verify() folds.

    Null values of any field count as such; a null source is a source of its own,
    before the others; null ids come first, rows of equal ids in order of their
    leaves, repeated rows once each. Very long texts are hashed whole. Columns
    beside fields, source_col and id_col change nothing, whatever their names. An
    empty table gives an empty result.
    """
    own = leaf(*[F.col(f"`{f}`") for f in fields])
    leaves = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"), own.alias("own"), (altered if altered is not None else F.lit(None).cast("string")).alias("other"))
    leaves = leaves.select("source", "id", F.unhex("own").alias("node"), F.when(F.col("other") != F.col("own"), F.unhex("other")).alias("other"))
    # stored first: a range partitioning reads its rows twice, and texts are long
    ranked = _ranked(stored(leaves, "merkle-leaves"), "source", ["id", "node", "other"], "merkle-order")
    # ids as text: a null would make numbers of them in pandas
    blocks = stored(_blocks(ranked.withColumn("id", F.col("id").cast("string")), ["id", "other"]), "merkle-blocks")
    whole = _paths(blocks, top)
    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, source string, place long" + f", proof {_PATH}" * proofs

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for source, n, block, hexes, ids, others, path, subroot, root in pdf[["source", "n", "block", "nodes", "id", "other", "path", "subroot", "root"]].itertuples(index=False):
                levels, above = grown(hexes, _height(n)), [(x["place"], x["run"]) for x in path]
                rest = "".join(siblings(*x) for x in above)
                rows, tails = [], {}
                for k, other in enumerate(others):
                    mine = path_of(levels, k)
                    if mine and k // RUN not in tails:
                        tails[k // RUN] = "".join(siblings(*x) for x in mine[1:]) + rest
                    node = hexes[k * _HEX : (k + 1) * _HEX]
                    root_ = folded(other.hex() if other is not None else node, mine + above)
                    proof = digest(siblings(*mine[0]) + tails[k // RUN] if mine else rest)
                    rows.append((node, subroot, root, proof, root_, root_ == root, source, int(block) * RUN**LEVELS + k, *([mine + above] if proofs else [])))
                out = pd.DataFrame(rows, columns=["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "source", "place", *(["proof"] if proofs else [])])
                out.insert(0, "id", list(ids))
                yield out

    out = whole.select("source", "n", "block", "nodes", "id", "other", "path", "subroot", "root").mapInPandas(finish, schema)
    return out.withColumn("id", F.col("id").cast(dict(leaves.dtypes)["id"])).withColumnRenamed("id", id_col)


def verify(leaf_col: Column | str, proof_col: Column | str) -> Column:
    """The root over a leaf and its proof, as manifest(proofs=True) gives it; null if either is."""

    @F.pandas_udf("string")
    def fold(node: pd.Series, proof: pd.Series) -> pd.Series:
        return pd.Series([folded(x, [(p["place"], p["run"]) for p in y]) if x is not None and y is not None else None for x, y in zip(node, proof)], dtype=object)

    return fold(leaf_col, proof_col)
