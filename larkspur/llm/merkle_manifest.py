"""A Merkle manifest of a dataset: a tree over the rows of each part, and one over the parts' roots.

The node store is a folder of Parquet files, one partition per level. Leaves are written as sorted runs (range
partitioned by part and key), and a leaf's coordinate is its rank in its part: the rows of its part in earlier files,
and its place in its file. Each pass reads one level and writes the next STRIDE levels: STRIDE levels above a run of
FANOUT ** STRIDE consecutive nodes need no other nodes, so a task holds a few hundred digests at a time, whatever
the size of a part. Passes go on while any part has more than one node.

Proofs are extracted by merging levels by coordinate, from the top down: the proof of a node is what lies beside
it within its run of STRIDE levels, followed by the proof of the run's top. Leaves meet only the last of these merges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import if_small, shared_dir, stored, table

FANOUT, STRIDE = 2, 8
#: One level of a proof: digests of the node's run to its left and to its right, as one text each (empty: none).
STEP = "struct<left: string, right: string>"
ROW_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(x: Column) -> Column:
    return F.sha2(x, 256)


def leaf_digest(*columns: Column) -> Column:
    """The digest of a row: each value as its length in bytes and itself, nulls as '-'."""
    told = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return digest(F.concat(*(told(c) for c in columns)))


def part_key(lang: Column) -> Column:
    """A text that is never null and sorts as ``lang`` does, null first."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with ``part``) and ``idx``, their rank from 0 in their part by ``order``; written as sorted runs, no part in one task.

    ``order`` must tell different rows apart. The ranks come from the written files, so they are the same whenever they are read.
    """
    spark = rows.sparkSession
    path = shared_dir(spark)
    rows.repartitionByRange("part", *order).sortWithinPartitions("part", *order).write.parquet(path)
    runs = spark.read.schema(rows.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = stored(runs.groupBy("part", "__file").agg(F.count("*").alias("n"), F.min("__row").alias("first")))
    # files are named by partition, so by order; a part has few files beside its rows
    earlier = F.expr("coalesce(sum(n) over (partition by part order by __file rows between unbounded preceding and 1 preceding), 0)")
    files = files.select("part", "__file", (earlier - F.col("first")).alias("__shift"))
    return runs.join(if_small(files, 100_000), ["part", "__file"]).select(*rows.columns, (F.col("__row") + F.col("__shift")).alias("idx"))


def depth(n: Column, fanout: int = FANOUT) -> Column:
    """Levels above ``n`` leaves up to a single node."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(n.cast("long").alias("n"), F.lit(0).alias("d")), lambda s, _: F.when(s["n"] <= 1, s).otherwise(
        F.struct(F.ceil(s["n"] / fanout).cast("long").alias("n"), (s["d"] + 1).alias("d"))
    ), lambda s: s["d"])


def parents(nodes: Column, fanout: int) -> Column:
    """Digests of runs of ``fanout`` nodes; the last run may have fewer."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / fanout).cast("int") - 1)
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * fanout + 1, fanout), "")))


@dataclass
class Manifest:
    """Coordinates of the leaves (the given columns, part, leaf, idx) and the node store: (part, run, nodes) by level, and parts (part, n, depth, subroot)."""

    leaves: DataFrame
    store: str
    parts: DataFrame
    fanout: int
    stride: int

    def levels(self) -> DataFrame:
        return self.leaves.sparkSession.read.schema("part string, run long, nodes array<string>, level int").parquet(self.store)

    def nodes(self) -> DataFrame:
        """(part, level, idx, hash) of every node above the leaves' level and of the leaves."""
        width = F.lit(float(self.fanout)) ** (self.stride - 1 - F.pmod(F.col("level") - 1, F.lit(self.stride)))
        rows = self.levels().select("part", "level", "run", F.posexplode("nodes").alias("at", "hash"), width.cast("long").alias("width"))
        upper = rows.select("part", "level", (F.col("run") * F.col("width") + F.col("at")).alias("idx"), "hash")
        return self.leaves.select("part", F.lit(0).alias("level"), "idx", F.col("leaf").alias("hash")).unionByName(upper)


def tree(leaves: DataFrame, fanout: int = FANOUT, stride: int = STRIDE) -> Manifest:
    """The trees over ``leaves`` (part, leaf, idx): a node is the digest of up to ``fanout`` consecutive ones, while a part has several."""
    spark = leaves.sparkSession
    store, size = shared_dir(spark), fanout**stride
    counts = stored(leaves.groupBy("part").agg(F.count("*").alias("n"), F.max(F.when(F.col("idx") == 0, F.col("leaf"))).alias("lone")))
    counts = counts.withColumn("depth", depth(F.col("n"), fanout))
    level = leaves.select("part", "idx", F.col("leaf").alias("hash"))
    highest = counts.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    for base in range(0, highest, stride):
        if base:  # the level that the pass before wrote last: one node of each run
            below = spark.read.schema("part string, run long, nodes array<string>, level int").parquet(store).where(F.col("level") == base)
            level = below.select("part", F.col("run").alias("idx"), F.get("nodes", F.lit(0)).alias("hash"))
        runs = level.groupBy("part", F.floor(F.col("idx") / size).alias("run")).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"]).alias("nodes"))
        runs = runs.join(if_small(counts.select("part", "depth").where(F.col("depth") > base), 100_000), "part")
        steps = F.sequence(F.lit(1), F.least(F.lit(stride), F.col("depth") - base))
        above = F.aggregate(steps, F.array("nodes"), lambda all_, _: F.array_append(all_, parents(F.element_at(all_, -1), fanout)))
        rows = runs.select("part", "run", F.posexplode(F.slice(above, 2, stride)).alias("at", "nodes"))
        rows.select("part", "run", "nodes", (F.col("at") + 1 + base).cast("int").alias("level")).write.mode("append").partitionBy("level").parquet(store)
    if not highest:  # lone leaves only
        spark.createDataFrame([], "part string, run long, nodes array<string>, level int").write.partitionBy("level").parquet(store)
    made = Manifest(leaves, store, counts, fanout, stride)
    tops = made.levels().join(counts.select("part", "depth"), "part").where("level = depth").select("part", F.get("nodes", F.lit(0)).alias("top"))
    made.parts = stored(counts.join(tops, "part", "left").select("part", "n", "depth", F.coalesce("top", "lone").alias("subroot")))
    return made


def proofs(made: Manifest) -> DataFrame:
    """The leaves of a manifest with ``proof``: for each level up to the root of their part, what stands left and right of their node (STEP)."""
    spark = made.leaves.sparkSession
    size = made.fanout**made.stride
    highest = made.parts.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    upper = None  # (part, idx, proof) of the nodes of the level that the pass before ended at
    if not highest:
        return made.leaves.withColumn("proof", F.array().cast(f"array<{STEP}>"))
    for base in range((highest - 1) // made.stride * made.stride, -1, -made.stride):
        if base:
            rows = made.levels().where(F.col("level") == base).select("part", F.col("run").alias("idx"), F.get("nodes", F.lit(0)).alias("leaf"))
        else:
            rows = made.leaves
        # the base level's nodes by run, and the levels above them
        base_level = rows.groupBy("part", F.floor(F.col("idx") / size).alias("run")).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "leaf"))), lambda x: x["leaf"]).alias("nodes"))
        between = made.levels().where(F.col("level").between(base + 1, base + made.stride - 1)).select("part", "run", "level", "nodes")
        runs = base_level.select("part", "run", F.lit(base).alias("level"), "nodes").unionByName(between)
        runs = runs.groupBy("part", "run").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "nodes"))), lambda x: x["nodes"]).alias("levels"))
        runs = runs.join(if_small(made.parts.select("part", "depth"), 100_000), "part")
        if upper is not None:
            runs = runs.join(upper.select("part", F.col("idx").alias("run"), F.col("proof").alias("rest")), ["part", "run"], "left")
        else:
            runs = runs.withColumn("rest", F.lit(None).cast(f"array<{STEP}>"))
        # written, so that the arrays above aren't made anew for every leaf of a run
        runs = stored(runs.select("part", "run", "levels", F.least(F.lit(made.stride), F.col("depth") - base).cast("int").alias("steps"), F.coalesce("rest", F.array().cast(f"array<{STEP}>")).alias("rest")))
        met = rows.withColumn("run", F.floor(F.col("idx") / size)).join(runs, ["part", "run"], "left")
        own = beside(F.col("levels"), F.pmod("idx", F.lit(size)), F.col("steps"), made.fanout)
        met = met.select(*rows.columns, F.coalesce(F.concat(own, "rest"), F.array().cast(f"array<{STEP}>")).alias("proof"))
        upper = stored(met.select("part", "idx", "proof")) if base else met
    return upper


def beside(levels: Column, at: Column, steps: Column, fanout: int) -> Column:
    """STEPs of the node at ``at`` in the lowest of ``levels``, for so many steps (maybe none)."""

    def step(j: Column) -> Column:
        place = F.floor(at / F.pow(F.lit(float(fanout)), j)).cast("int")
        first = place - F.pmod(place, F.lit(fanout))
        row = F.get(levels, j)
        left = F.array_join(F.slice(row, first + 1, place - first), "")
        right = F.array_join(F.slice(row, place + 2, first + fanout - place - 1), "")
        return F.struct(left.alias("left"), right.alias("right"))

    return F.when(steps > 0, F.transform(F.sequence(F.lit(0), steps - 1), step)).otherwise(F.array().cast(f"array<{STEP}>"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and ``proof`` lead to."""
    return F.aggregate(proof, leaf, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def siblings(proof: Column) -> Column:
    """All digests of a proof as one text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


@dataclass
class DatasetManifest:
    """The trees of all parts and the tree over them; ``root`` (part, subroot, root, proof) has a row for each part."""

    rows: Manifest
    top: Manifest
    roots: DataFrame

    def proven(self) -> DataFrame:
        """The leaves with ``subroot``, ``root`` and ``proof`` up to the root of the dataset."""
        over = self.roots.select("part", "subroot", "root", F.col("proof").alias("over"))
        found = proofs(self.rows).join(if_small(over, 10_000), "part")
        return found.withColumn("proof", F.concat("proof", "over")).drop("over")


def manifest(leaves: DataFrame, order: list[str], fanout: int = FANOUT, stride: int = STRIDE) -> DatasetManifest:
    """The manifest of ``leaves`` (part, leaf and other columns): a part's leaves by ``order`` (leaf last), the parts by name.

    Rows that are equal in ``order`` are ordered by leaf; equal leaves are alike in either order. No leaves give no parts.
    """
    rows = tree(placed(leaves, [*order, "leaf"]), fanout, stride)
    tops = rows.parts.select(F.lit("").alias("part"), F.col("part").alias("name"), F.col("subroot").alias("leaf"))
    top = tree(placed(tops, ["name"]), fanout, stride)
    roots = proofs(top).join(F.broadcast(top.parts.select("part", F.col("subroot").alias("root"))), "part")  # a single row
    return DatasetManifest(rows, top, stored(roots.select(F.col("name").alias("part"), F.col("leaf").alias("subroot"), "root", "proof")))


def document_manifest(docs: DataFrame, *kept: Column) -> DatasetManifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text) by lang, rows ascending by doc_id, null first; ``kept`` columns stay with the leaves.

    Nulls in any column have a leaf of their own; repeated rows are leaves side by side. Other columns aren't part of a leaf.
    """
    leaf = leaf_digest(*(F.col(c) for c in ROW_COLUMNS)).alias("leaf")
    return manifest(docs.select(part_key(F.col("lang")).alias("part"), "doc_id", leaf, *kept), ["doc_id"])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    altered = leaf_digest(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in ROW_COLUMNS))
    tampered = F.when((F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0) & F.col("n_chars").isNotNull(), altered)
    rows = document_manifest(docs, tampered.alias("tampered")).proven()
    rows = rows.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("proof"))).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = r"""
WITH RECURSIVE t AS (SELECT *, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS part,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source)::VARCHAR || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang)::VARCHAR || ':' || lang END AS head, CASE WHEN text IS NULL THEN '-' ELSE strlen(text)::VARCHAR || ':' || text END AS tail,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))) AS crc
  FROM documents),
l AS (SELECT doc_id, part, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST) - 1 AS idx,
    sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR END || tail) AS leaf,
    sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + CASE WHEN xor(crc, 4294967295::BIGINT) % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR)::VARCHAR || ':'
      || (n_chars + CASE WHEN xor(crc, 4294967295::BIGINT) % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR END || tail) AS shown FROM t),
n AS (SELECT part, 0 AS level, idx, leaf AS h, count(*) OVER (PARTITION BY part) AS total FROM l
  UNION ALL SELECT part, level + 1, idx // 2, h, total FROM (
    SELECT part, level, idx, sha256(h || coalesce(lead(h) OVER (PARTITION BY part ORDER BY idx), '')) AS h, (total + 1) // 2 AS total, total AS had FROM n) WHERE had > 1 AND idx % 2 = 0),
s AS (SELECT part, h AS subroot, row_number() OVER (ORDER BY part) - 1 AS idx, count(*) OVER () AS total FROM n WHERE total = 1),
u AS (SELECT 0 AS level, idx, subroot AS h, total FROM s
  UNION ALL SELECT level + 1, idx // 2, h, total FROM (SELECT level, idx, sha256(h || coalesce(lead(h) OVER (ORDER BY idx), '')) AS h, (total + 1) // 2 AS total, total AS had FROM u) WHERE had > 1 AND idx % 2 = 0),
root AS (SELECT h AS root FROM u WHERE total = 1),
p AS (SELECT part, doc_id, l.idx AS id, n.level, l.idx >> n.level AS spot, coalesce(n.h, '') AS h FROM l JOIN (SELECT part, level, idx, h, total FROM n UNION ALL SELECT part, level, total, '', total FROM n WHERE idx = 0 AND total > 1 AND total % 2 = 1) AS n
    USING (part) WHERE n.total > 1 AND n.idx = xor(l.idx >> n.level, 1)
  UNION ALL SELECT part, doc_id, l.idx, 1000 + u.level, s.idx >> u.level, u.h FROM l JOIN s USING (part), (SELECT level, idx, h, total FROM u UNION ALL SELECT level, total, '', total FROM u WHERE idx = 0 AND total > 1 AND total % 2 = 1) AS u
    WHERE u.total > 1 AND u.idx = xor(s.idx >> u.level, 1)),
g AS (SELECT part, id, list({'h': h, 'odd': spot % 2 = 1} ORDER BY level) AS steps, string_agg(h, '' ORDER BY level) AS proof FROM p GROUP BY part, id),
f AS (SELECT l.part, l.idx, 0 AS k, shown AS h FROM l
  UNION ALL SELECT f.part, f.idx, k + 1, CASE WHEN g.steps[k + 1].odd THEN sha256(g.steps[k + 1].h || f.h) ELSE sha256(f.h || g.steps[k + 1].h) END FROM f JOIN g ON g.part = f.part AND g.id = f.idx WHERE k < len(g.steps))
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM l JOIN s USING (part) LEFT JOIN g ON g.part = l.part AND g.id = l.idx JOIN f ON f.part = l.part AND f.idx = l.idx AND f.k = coalesce(len(g.steps), 0), root
"""
