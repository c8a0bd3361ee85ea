"""A Merkle manifest of a dataset: leaves by group, a tree of each group, a tree over the groups' roots, proofs.

Superblock reduction. Nodes of a level are numbered without gaps in their group; bucket = number div fanout**levels. A
bucket is one small pandas group (at most fanout**levels nodes, whatever the group's size) that collapses ``levels``
levels and gives one node, so a round leaves 1 / fanout**levels of the nodes; rounds go on until each group has one. The
way down takes the tables of the way up in reverse: each bucket meets the one proof of its own node, adds the siblings
inside the bucket and hands out proofs of its nodes, lower part first. So a proof is never shuffled with a leaf: a bucket's
upper part is sent once.

A bucket needs no count of its group: the first bucket, if it is not full, is the only one and is reduced to a single
node; any other is reduced by exactly ``levels`` levels, where a run of one is hashed like others. A full only bucket comes
to one node either way.

Numbers come from range shards: rows are ranged by (group, order), counted on within each shard as Arrow batches pass,
and a shard's first group goes on from the shards before (a table of at most one row a shard). A group of any size is so
dealt to many tasks.

Repeated rows are leaves of their own, with the same value; rows of one id go by leaf. Rows without an id come first
within their group and are never tampered; a null group is a group of its own and comes first. Null columns count as ``-``,
an empty text as ``0:``. Extra columns are ignored. An empty table has no leaves and gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "siblings array<string>, places array<int>, runs array<int>"


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """SHA-256 of the fields, each as its length in bytes, a colon and its value, or as a dash if it is null."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts]), 256)


def collapse(nodes: list[str], only: bool, fanout: int, levels: int) -> list[list[str]]:
    """The levels of a bucket from its nodes up; ``only``: it is the whole group, and ends with a single node."""
    out = [nodes]
    for _ in range(levels):
        if only and len(out[-1]) == 1:
            break
        out.append([digest(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def fold(node: str, siblings: list[str], places: list[int], runs: list[int]) -> str:
    """The root that a node and its proof give: at each level the node takes its place among its siblings."""
    at = 0
    for place, run in zip(places, runs, strict=True):
        others = siblings[at : at + run - 1]
        node = digest([*others[:place], node, *others[place:]])
        at += run - 1
    return node


def _counted(batches):
    """Adds ``at``: the number of rows of the same group before, within a sorted shard."""
    last, n = object(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("part").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        at = np.arange(len(codes)) - np.repeat(starts, np.diff([*starts, len(codes)]))
        if batch.column("part")[0].as_py() == last:
            at[: starts[1] if len(starts) > 1 else len(codes)] += n
        last, n = batch.column("part")[-1].as_py(), int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "at"])


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with idx, their number from 0 within ``part`` by ``order``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", at long"
    x = rows.repartitionByRange("part", *order).sortWithinPartitions("part", *order).mapInArrow(_counted, schema)
    x = stage(x.withColumn("shard", F.spark_partition_id()), "merkle-placed")
    per = x.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    on = per.select(F.col("part").alias("p"), F.col("shard").alias("s"), before.alias("before")).where("before > 0")  # the first group of a shard: at most a row a shard
    x = x.join(F.broadcast(on), F.col("part").eqNullSafe(F.col("p")) & (F.col("shard") == F.col("s")), "left")
    return x.withColumn("idx", F.col("at") + F.coalesce("before", F.lit(0))).drop("p", "s", "before", "at", "shard")


def _up(fanout: int, levels: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf.sort_values("idx")["node"].tolist()
        top = collapse(nodes, key[1] == 0 and len(nodes) < fanout**levels, fanout, levels)[-1]
        return pd.DataFrame({"part": pd.Series([pdf["part"].iloc[0]], dtype=object), "idx": [key[1]], "node": top})

    return run


def _down(fanout: int, levels: int, keep: list[str]):
    def run(key, pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        pdf, upper = pdf.sort_values("idx"), above.iloc[0]
        nodes = pdf["node"].tolist()
        tree = collapse(nodes, key[1] == 0 and len(nodes) < fanout**levels, fanout, levels)[:-1]
        siblings, places, runs = [], [], []
        for i in range(len(nodes)):
            others, place, many, j = [], [], [], i
            for level in tree:
                first = j - j % fanout
                row = level[first : first + fanout]
                others += row[: j % fanout] + row[j % fanout + 1 :]
                place.append(j % fanout)
                many.append(len(row))
                j //= fanout
            siblings.append([*others, *upper["siblings"]])
            places.append([*place, *upper["places"]])
            runs.append([*many, *upper["runs"]])
        out = pdf[keep].assign(siblings=siblings, places=places, runs=runs, root=upper["root"])
        if "subroot" in above:
            out = out.assign(subroot=upper["subroot"])
        if "claimed" in keep:
            claims = [n if c is None or c != c else c for c, n in zip(pdf["claimed"], nodes, strict=True)]
            out = out.assign(folded_root=[fold(*x) for x in zip(claims, siblings, places, runs, strict=True)])
        return out

    return run


def _climb(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Tables (part, idx, node) of each round, up to one node a group."""
    out = [nodes]
    while (out[-1].agg(F.max("idx")).first()[0] or 0) > 0:
        x = out[-1].select("part", "idx", "node", F.expr(f"idx div {fanout**levels}").alias("bucket"))
        out.append(stage(x.groupBy("part", "bucket").applyInPandas(_up(fanout, levels), "part string, idx long, node string"), "merkle-nodes"))
    return out


def _descend(tables: list[DataFrame], top: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Proofs of the first table's nodes; ``top``: (part, idx, proof columns) of the last one's."""
    for nodes in reversed(tables[:-1]):
        x = nodes.withColumn("bucket", F.expr(f"idx div {fanout**levels}"))
        keep = [c for c in nodes.columns]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields) + f", {_PATH}, root string"
        schema += ", subroot string" if "subroot" in top.columns else ""
        schema += ", folded_root string" if "claimed" in keep else ""
        top = x.groupBy("part", "bucket").cogroup(top.groupBy("part", "idx")).applyInPandas(_down(fanout, levels, keep), schema)
        if nodes is not tables[0]:
            top = stage(top.drop("node"), "merkle-proofs")
    return top


def manifest(leaves: DataFrame, fanout: int = 16, levels: int = 2) -> DataFrame:
    """``leaves`` (part: group or null, doc_id, leaf, claimed: another leaf to verify or null, row: breaks ties) with
    subroot, root, the proof (siblings, places, runs: one entry a level for the last two) and folded_root, the root that
    the claimed leaf, else the leaf, gives with that proof."""
    kind = leaves.schema["doc_id"].dataType  # ids pass pandas as text: it has no whole numbers with nulls
    rows = placed(leaves.withColumnRenamed("leaf", "node"), "doc_id", "node", "row").drop("row")
    rows = stage(rows.withColumn("doc_id", F.col("doc_id").cast("string")), "merkle-leaves")
    tables = _climb(rows, fanout, levels)
    subroots = tables[-1].select(F.lit("").alias("part"), F.col("part").alias("source"), "node")
    subroots = stage(placed(subroots, "source"), "merkle-subroots")
    upper = _climb(subroots, fanout, levels)
    top = upper[-1].select("part", "idx", *[F.array().cast(t.split()[-1]).alias(t.split()[0]) for t in _PATH.split(", ")], F.col("node").alias("root"))
    if len(upper) > 1:
        top = _descend(upper, top, fanout, levels)
    else:
        top = top.join(subroots.select("idx", "source", "node"), "idx")  # one group
    top = top.select(F.col("source").alias("part"), F.lit(0).cast("long").alias("idx"), "siblings", "places", "runs", "root", F.col("node").alias("subroot"))
    if len(tables) == 1:  # groups of one leaf: a round that reduces nothing
        tables.append(tables[0].select("part", "idx", "node"))
    top = stage(top, "merkle-proofs")
    return _descend(tables, top, fanout, levels).withColumnRenamed("node", "leaf").withColumn("doc_id", F.col("doc_id").cast(kind)).drop("idx")


def tampered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op13_superblocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = leaf_of(*[F.col(c) for c in FIELDS[:-1]], tampered(F.col("text")))
    leaves = docs.select(F.col("source").alias("part"), "doc_id", leaf_of(*[F.col(c) for c in FIELDS]).alias("leaf"), F.when(chosen, other).alias("claimed"), F.monotonically_increasing_id().alias("row"))
    x = manifest(stage(leaves, "merkle-rows"))
    out = x.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
    return stage(out, "manifest")


def _sql() -> str:
    """The query in DuckDB SQL, with its levels written out: up to 16**6 leaves a source and 16**3 sources."""
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"
    hashed = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in (*FIELDS[:-1], text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [
        f"raw AS (SELECT doc_id, source, {hashed('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {hashed(lower)} END AS claimed FROM documents)",
        "rows AS (SELECT *, row_number() OVER (ORDER BY 1) AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM raw)",
        "a0 AS (SELECT source AS g, i, leaf AS node FROM rows)",
    ]

    def levels(t: str, many: int) -> None:
        for k in range(many):
            near = "string_agg(node, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN {} AND {})"
            out.append(f"{t}s{k} AS (SELECT g, i, count(*) OVER (PARTITION BY g) AS n, coalesce({near.format('UNBOUNDED PRECEDING', '1 PRECEDING')}, '') AS b, coalesce({near.format('1 FOLLOWING', 'UNBOUNDED FOLLOWING')}, '') AS e FROM {t}{k})")
            out.append(f"{t}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN max(n) = 1 THEN max(node) ELSE sha256(string_agg(node, '' ORDER BY i)) END AS node FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {t}{k}) GROUP BY g, i // 16)")

    levels("a", 6)
    out.append("tops AS (SELECT g AS source, node AS subroot, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS u FROM a6)")
    out.append("b0 AS (SELECT 0 AS g, u AS i, subroot AS node FROM tops)")
    levels("b", 3)
    out.append("x0 AS (SELECT r, doc_id, leaf, subroot, rows.source AS g, i, u, coalesce(claimed, leaf) AS node, '' AS proof FROM rows JOIN tops ON rows.source IS NOT DISTINCT FROM tops.source)")
    for k in range(9):
        t, at, group = (f"as{k}", f"x.i // {16**k}", "x.g") if k < 6 else (f"bs{k - 6}", f"x.u // {16 ** (k - 6)}", "0")
        out.append(f"x{k + 1} AS (SELECT x.* REPLACE (CASE WHEN s.n = 1 THEN x.node ELSE sha256(s.b || x.node || s.e) END AS node, CASE WHEN s.n = 1 THEN x.proof ELSE x.proof || s.b || s.e END AS proof) FROM x{k} x JOIN {t} s ON s.i = {at} AND s.g IS NOT DISTINCT FROM {group})")
    return "WITH " + ",\n".join(out) + "\nSELECT doc_id, leaf, subroot, b3.node AS root, sha256(proof) AS proof_sha256, x9.node AS folded_root, x9.node = b3.node AS verified FROM x9, b3"


ORACLE = _sql()
