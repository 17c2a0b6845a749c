"""A Merkle manifest of a dataset, its trees stored in van Emde Boas layout.

Each source's rows are the leaves of a tree in which 16 consecutive nodes make their parent; the sources'
roots are the leaves of one more such tree. A tree is cut into aligned subtrees of ``LEVELS`` levels: a
subtree is one row of a table (``nodes``: its digests end to end), and the roots of subtrees are the leaves
of the next tier, which is cut and stored alike. Within a subtree the levels are split at half height, again
and again: first the upper half, then the lower trees one after another, each in the same order. Where a
node stands follows from (leaves, levels, level, index) by arithmetic alone, with no pointers and no gaps;
the same arithmetic puts digests there when a subtree is built and finds the siblings of a path later.

Leaves get their numbers from counts of sorted ranges (``order.numbered``), so one source may hold any share
of the rows; no group is larger than a subtree (4096 leaves). Proofs are read from the top tier down: each
tier hands every child the path above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haploom.llm.duck import CRC_BITS, crc32
from haploom.llm.licenses import LOWER, UPPER
from haploom.operators.order import numbered
from haploom.session import staged

#: Children of a node.
FAN = 16
#: Levels of a stored subtree, leaves and root included; a subtree holds FAN ** (LEVELS - 1) leaves at most.
LEVELS = 4
#: What a leaf is the digest of.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bytes of a digest.
WIDTH = 32
PATH = "array<struct<before:string,after:string>>"


# --- address arithmetic --------------------------------------------------------------------------


def height(n: int) -> int:
    """Levels of a tree over n leaves."""
    levels = 1
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def size(n: int, levels: int) -> int:
    """Nodes of a tree of so many leaves and levels."""
    return sum(-(-n // FAN**level) for level in range(levels))


def address(n: int, levels: int, level: int, index: np.ndarray) -> np.ndarray:
    """Where nodes of one level stand in the layout of a tree of n leaves; level 0 holds the leaves."""
    if levels == 1:
        return index
    low = levels // 2
    high = levels - low
    above = -(-n // FAN**low)
    if level >= low:
        return address(above, high, level - low, index)
    span, wide = FAN ** (low - 1), FAN ** (low - 1 - level)
    tree = index // wide
    start = size(above, high) + tree * size(span, low)
    last, rest = divmod(n, span)
    within = address(span, low, level, index - tree * wide)
    if rest:  # of the lower trees only the last one may lack leaves
        cut = tree == last
        within[cut] = address(rest, low, level, (index - tree * wide)[cut])
    return start + within


def build_block(leaves: list[str], levels: int) -> tuple[bytes, str]:
    """(digests in layout order, root) of a subtree; the root of a single leaf of one level is the leaf."""
    n = len(leaves)
    out = np.empty((size(n, levels), WIDTH), dtype=np.uint8)
    nodes = leaves
    for level in range(levels):
        out[address(n, levels, level, np.arange(len(nodes)))] = np.frombuffer(bytes.fromhex("".join(nodes)), dtype=np.uint8).reshape(-1, WIDTH)
        if level < levels - 1:
            nodes = [sha256("".join(nodes[i : i + FAN]).encode()).hexdigest() for i in range(0, len(nodes), FAN)]
    return out.tobytes(), nodes[0]


def siblings(packed: bytes, n: int, levels: int) -> list[list[tuple[str, str]]]:
    """For each leaf of a subtree, its path to the subtree's root: what stands before and after it among the
    nodes that have its parent, level by level."""
    nodes = np.frombuffer(packed, dtype=np.uint8).reshape(-1, WIDTH)
    steps: list[list[tuple[str, str]]] = []
    for level in range(levels - 1):
        count = -(-n // FAN**level)
        text = nodes[address(n, levels, level, np.arange(count))].tobytes().hex()
        own = []
        for i in range(count):
            first, last = i // FAN * FAN, min(i // FAN * FAN + FAN, count)
            own.append((text[2 * WIDTH * first : 2 * WIDTH * i], text[2 * WIDTH * (i + 1) : 2 * WIDTH * last]))
        steps.append(own)
    return [[steps[level][i // FAN**level] for level in range(levels - 1)] for i in range(n)]


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        leaf = sha256(f"{before}{leaf}{after}".encode()).hexdigest()
    return leaf


# --- trees as tables -----------------------------------------------------------------------------


def leaf(row: dict[str, Column]) -> Column:
    """Digest of a row's fields: each is '-' if null, else its length in bytes, ':' and its text."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in row.values()]
    return F.sha2(F.concat(*parts), 256)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _tiers(leaves: DataFrame, carried: list[str], deep: int) -> list[DataFrame]:
    """The stored subtrees (tree, block, n, levels, nodes, root, members) of every tree, tier by tier.

    ``leaves``: tree, at (from 0), leaf and the columns that the leaves carry, which the first tier keeps in ``members``;
    ``deep``: levels of a subtree.
    """
    span = FAN ** (deep - 1)
    totals = staged(leaves.groupBy("tree").agg(F.count("*").alias("total")), "merkle-totals")
    most = totals.agg(F.max("total")).first()[0] or 0
    kind = "array<struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in leaves.select(*carried).schema) + ">>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            packed, root = build_block(row["leaves"], row["levels"])
            yield pa.RecordBatch.from_pylist([{**row, "nodes": packed, "root": root}], schema=arrow)

    tiers: list[DataFrame] = []
    while True:
        own = kind if not tiers else "array<struct<leaf:string>>"
        told = carried if not tiers else ["leaf"]
        groups = leaves.groupBy("tree", F.floor(F.col("at") / span).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "leaf", *(c for c in told if c != "leaf")))).alias("all"))
        alone = F.ceil(F.col("total") / F.lit(float(span ** len(tiers)))) <= span
        levels = F.lit(1) + sum(((F.size("all") > FAN**i).cast("int") for i in range(deep - 1)), F.lit(0))
        blocks = groups.join(totals, "tree").select(
            "tree", "block", F.size("all").alias("n"), F.when(alone, levels).otherwise(deep).alias("levels"), F.col("all.leaf").alias("leaves"),
            F.transform("all", lambda x: F.struct(*(x[c].alias(c) for c in told))).alias("members"),
        )
        arrow = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("levels", pa.int32()), ("nodes", pa.binary()), ("root", pa.string()), ("members", _arrow(blocks, "members"))])
        tiers.append(staged(blocks.mapInArrow(run, f"tree string, block long, n int, levels int, nodes binary, root string, members {own}"), "merkle-blocks"))
        if most <= span ** len(tiers):
            return tiers
        # trees that this tier ends do not go on; block roots are the next tier's leaves
        leaves = tiers[-1].join(totals.where(F.col("total") > span ** len(tiers)), "tree", "left_semi").select("tree", F.col("block").alias("at"), F.col("root").alias("leaf"))


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _roots(tiers: list[DataFrame]) -> DataFrame:
    """tree, root, place: each tree's last subtree is the one that stands alone in its tier."""
    found = None
    for number, tier in enumerate(tiers):
        own = tier.where("block = 0").select("tree", "root", F.lit(number).alias("tier"))
        found = own if found is None else found.unionByName(own)
    return found.groupBy("tree").agg(F.max_by("root", "tier").alias("root"), F.max("tier").alias("tier"))


@dataclass
class Manifest:
    """``documents`` and ``sources``: tiers of stored subtrees, lowest first. ``roots``: tree, root, tier of each source.
    ``span``: leaves of a subtree at most."""

    documents: list[DataFrame]
    sources: list[DataFrame]
    roots: DataFrame
    span: int

    def blocks(self) -> DataFrame:
        """of, tier, tree, block, n, levels, nodes, root: all stored subtrees, as one table to be kept."""
        out = None
        for of, tiers in (("documents", self.documents), ("sources", self.sources)):
            for number, tier in enumerate(tiers):
                own = tier.select(F.lit(of).alias("of"), F.lit(number).alias("tier"), *(c for c in tier.columns if c != "members"))
                out = own if out is None else out.unionByName(own)
        return out


def manifest(leaves: DataFrame, levels: int = LEVELS) -> Manifest:
    """Build the trees of ``leaves``: doc_id, source, leaf and perhaps ``claimed``, a digest that proofs are to be
    tried with in its place. Leaves ascend by doc_id, null first; equal ids by their digests. A null source
    is a source of its own and the first one; the others follow by their bytes. An empty table has no trees."""
    carried = ["doc_id", "leaf", *(["claimed"] if "claimed" in leaves.columns else [])]
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rows = staged(leaves.select(tree.alias("tree"), *carried), "merkle-leaves")
    documents = _tiers(numbered(rows, [F.asc_nulls_first("doc_id"), "leaf"], ["tree"], "at"), carried, levels)
    roots = staged(_roots(documents), "merkle-roots")
    tops = numbered(roots.select(F.col("tree").alias("of"), F.col("root").alias("leaf")), ["of"], name="at").withColumn("tree", F.lit(""))
    return Manifest(documents, _tiers(tops, ["of", "leaf"], levels), roots, FAN ** (levels - 1))


def _down(tier: DataFrame, above: DataFrame, span: int) -> DataFrame:
    """tree, root (of all), place, path, and the carried columns: each leaf of a tier's subtrees with its whole path.

    ``above``: tree, block, root (of all) and the path above each subtree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            up = [(x["before"], x["after"]) for x in row["path"]]
            start = row["block"] * span
            paths = siblings(row["nodes"], row["n"], row["levels"])
            for a in range(0, row["n"], 256):
                yield pa.RecordBatch.from_pylist(
                    [
                        {"tree": row["tree"], "all": row["all"], "subroot": row["subroot"], "place": start + a + i, "path": [{"before": x, "after": y} for x, y in path + up], "member": m}
                        for i, (path, m) in enumerate(zip(paths[a : a + 256], row["members"][a : a + 256], strict=True))
                    ],
                    schema=arrow,
                )

    joined = tier.join(above, ["tree", "block"])
    member = joined.schema["members"].dataType.elementType
    path = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    arrow = pa.schema([("tree", pa.string()), ("all", pa.string()), ("subroot", pa.string()), ("place", pa.int64()), ("path", path), ("member", _arrow(joined.select(F.get("members", F.lit(0)).alias("member")), "member"))])
    return joined.select("tree", "block", "n", "levels", "nodes", "members", "all", "subroot", "path").mapInArrow(run, f"tree string, all string, subroot string, place long, path {PATH}, member {member.simpleString()}")


def _proved(tier: DataFrame, above: DataFrame) -> DataFrame:
    """The lowest tier: proofs of its leaves and what they fold to, without sending paths on."""
    with_claim = "claimed" in tier.schema["members"].dataType.elementType.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            up = [(x["before"], x["after"]) for x in row["path"]]
            tail = "".join(x + y for x, y in up).encode()
            out = []
            for path, m in zip(siblings(row["nodes"], row["n"], row["levels"]), row["members"], strict=True):
                proof = sha256("".join(x + y for x, y in path).encode())
                proof.update(tail)
                claimed = m.get("claimed") if with_claim else None
                folded = fold(fold(claimed or m["leaf"], path), up)
                out.append({"doc_id": m["doc_id"], "leaf": m["leaf"], "subroot": row["subroot"], "root": row["all"], "proof_sha256": proof.hexdigest(), "folded_root": folded, "verified": folded == row["all"]})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    arrow = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in names), ("verified", pa.bool_())])
    joined = tier.join(above, ["tree", "block"]).select("block", "n", "levels", "nodes", "members", "all", "subroot", "path")
    return joined.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} string" for c in names) + ", verified boolean")


def _paths(tiers: list[DataFrame], tops: DataFrame, span: int, tier_of: DataFrame | None = None) -> DataFrame:
    """(tree, block, all, subroot, path) above each subtree of the lowest tier. ``tops``: tree, all, subroot and path
    above each whole tree, whose highest tier is ``tier_of`` (the last one if None)."""
    above = None
    for number in range(len(tiers) - 1, -1, -1):
        ends = tops if tier_of is None else tops.join(tier_of.where(F.col("tier") == number).select("tree"), "tree", "left_semi")
        own = ends.select("tree", F.lit(0).cast("long").alias("block"), "all", "subroot", "path")
        here = own if above is None else above.unionByName(own) if tier_of is not None else above
        if number == 0:
            return here
        above = _down(tiers[number], here, span).select("tree", F.col("place").alias("block"), "all", "subroot", "path")


def proofs(found: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf.

    ``proof_sha256``: digest of the siblings, level by level up to the root of all. ``folded_root``: what the
    claimed digest (the leaf itself, if none is claimed) gives with those siblings; ``verified``: whether
    that is the root. One row for each leaf; repeated rows are leaves of their own.
    """
    root = found.sources[-1].select("tree", F.col("root").alias("all"), F.col("root").alias("subroot"), F.array().cast(PATH).alias("path"))
    above = _paths(found.sources, root, found.span)
    sources = _down(found.sources[0], above, found.span).select(F.col("member.of").alias("tree"), "all", F.col("member.leaf").alias("subroot"), "path")
    return _proved(found.documents[0], _paths(found.documents, sources, found.span, found.roots))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, each tried again with its text as it is after tampering: a fifth of them
    have A-Z in lower case."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    row = {c: F.col(c) for c in FIELDS}
    touched = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = leaf(row | {"text": F.translate("text", UPPER, LOWER)})
    return proofs(manifest(docs.select("doc_id", "source", leaf(row).alias("leaf"), F.when(touched, changed).alias("claimed"))))


def sql(levels: int = 6) -> str:
    """The same in DuckDB, level by level, for at most 16 ** ``levels`` rows of a source and so many sources."""
    field = lambda c, v: f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || {v}, '-')"
    row = lambda text: "sha256(concat(" + ", ".join(field(c, text if c == "text" else c) for c in FIELDS) + "))"
    parts = [
        CRC_BITS,
        f"""told AS (SELECT doc_id, coalesce('s' || source, 'n') AS tree, {row('text')} AS leaf,
      CASE WHEN {crc32("doc_id")} % 5 = 0 THEN {row(f"translate(text, '{UPPER}', '{LOWER}')")} END AS claimed FROM documents, bits)""",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot, count(*) OVER (PARTITION BY tree) AS n FROM told)",
        "a0 AS (SELECT tree, spot AS i, leaf AS h, n FROM placed)",
    ]

    def climb(of: str) -> None:
        for k in range(levels):
            parts.append(f"{of}r{k} AS (SELECT tree, i // 16 AS i, any_value(n) AS n, list(h ORDER BY i) AS run FROM {of}{k} GROUP BY tree, i // 16)")
            parts.append(f"{of}{k + 1} AS (SELECT tree, i, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h, (n + 15) // 16 AS n FROM {of}r{k})")

    def descend(of: str, start: str, place: str, key: str) -> str:
        for k in range(levels):
            p = f"CAST({place} // {16**k} % 16 AS BIGINT)"
            parts.append(
                f"""{of}f{k + 1} AS (SELECT f.* REPLACE (CASE WHEN r.n = 1 THEN folded ELSE sha256(array_to_string(list_concat(run[1:{p}], [folded], run[{p} + 2:17]), '')) END AS folded,
      CASE WHEN r.n = 1 THEN proof ELSE concat(proof, array_to_string(run[1:{p}], ''), array_to_string(run[{p} + 2:17], '')) END AS proof) FROM {start if k == 0 else f'{of}f{k}'} f JOIN {of}r{k} r ON r.tree = {key} AND r.i = {place} // {16 ** (k + 1)})"""
            )
        return f"{of}f{levels}"

    climb("a")
    parts.append(f"b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, h, count(*) OVER () AS n, tree AS of FROM a{levels})")
    climb("b")
    parts.append("opened AS (SELECT *, coalesce(claimed, leaf) AS folded, '' AS proof FROM placed)")
    low = descend("a", "opened", "spot", "f.tree")
    parts.append(f"over AS (SELECT f.*, b0.i AS top, b0.h AS subroot FROM {low} f JOIN b0 ON b0.of = f.tree)")
    last = descend("b", "over", "top", "''")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified FROM {last}, b{levels}"
