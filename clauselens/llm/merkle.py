"""A Merkle manifest of a dataset, with DataFrame functions: a tree for each source, and a tree over their roots.

Leaves of a tree are dealt into aligned blocks of RUN ** DEPTH. A block keeps each of its levels as one string of all
digests in order, 64 hex digits each: a parent is the digest of a substring of RUN * 64 digits, and the siblings of a
node are what flanks it within that substring. The roots of the blocks are the nodes of the next stage, until a tree
has one block; then the roots of the trees, in order, make a tree of their own. The way back down gives each block the
siblings above it, so that a row's proof is put together within its block and is never shuffled.

Positions come from sorted ranges: rows are dealt by (tree, order), and a position is the rows of the tree in the
ranges before plus the place within the range, so that no task gets a whole tree. A block has RUN ** DEPTH rows at
most.

Nulls in any column are hashed as `-`, and a null source is a tree of its own, before the others. A null doc_id comes
first in its tree and is not tampered with. Repeated rows are leaves of their own, next to each other. A tree of one
leaf has that leaf as its root; a single source's root is the root. A proof without siblings is the digest of nothing.
An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselens.llm.shared import discard, written

RUN, DEPTH, HEX = 3, 6, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def leaf_of(fields: list[Column]) -> Column:
    """The digest of a row: `-` for a null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `pos`, the place of a row in its `tree` by `order`, and `total`, the rows of the tree."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    held = ranged.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")
    held = held.select("tree", "_part", "_first", (F.sum("_n").over(tree.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(tree).alias("total"))
    out = ranged.join(held, ["tree", "_part"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")
    out.written_to = ranged.written_to
    return out


def parents(level: Column, run: int) -> Column:
    """The level above: digests of the substrings of `run` nodes."""
    last = F.ceil(F.octet_length(level) / F.lit(run * HEX)).cast("int") - 1
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda r: digest(F.substring(level, r * (run * HEX) + 1, F.lit(run * HEX)))), "").cast("binary")


def blocks_of(nodes: DataFrame, members: list[str], run: int, depth: int) -> DataFrame:
    """Blocks of nodes (tree, pos, total, node and `members`): tree, block, total, rows in order, height, levels and root.

    A tree of more than one block goes up `depth` levels in each, be it full or not; the only block ends at its root.
    """
    size = run**depth
    out = nodes.groupBy("tree", F.floor(F.col("pos") / size).alias("block"), "total").agg(F.array_sort(F.collect_list(F.struct("pos", "node", *members))).alias("rows"))
    heights = F.lit(0)
    for h in range(depth):
        heights = F.when(F.col("total") > run**h, F.lit(h + 1)).otherwise(heights)
    out = out.withColumn("height", heights).withColumn("base", F.array_join(F.col("rows.node"), "").cast("binary"))
    levels = F.aggregate(F.array_repeat(F.lit(0), F.col("height")), F.array("base"), lambda done, _: F.array_append(done, parents(F.element_at(done, -1), run)))
    return out.withColumn("levels", levels).withColumn("root", F.element_at("levels", -1).cast("string")).drop("base")


def siblings(levels: Column, height: Column, place: Column, run: int) -> Column:
    """For each level of a block, what stands left and right of the node above `place` within its run."""

    def flanks(_: Column, level: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(run), level)).cast("int")
        first = F.floor(at / run).cast("int") * (run * HEX)
        inside = at % run * HEX
        nodes = F.substring(F.get(levels, level), first + 1, F.lit(run * HEX))
        return F.struct(F.substring(nodes, F.lit(1), inside).alias("left"), F.substring(nodes, inside + HEX + 1, F.lit(run * HEX)).alias("right"))

    return F.transform(F.array_repeat(F.lit(0), height), flanks)


def fold(node: Column, path: Column) -> Column:
    """The root that a node and the siblings on its path lead to."""
    return F.aggregate(path, node.cast("binary"), lambda at, s: digest(F.concat(s["left"], at, s["right"])).cast("binary")).cast("string")


def proof(path: Column) -> Column:
    return digest(F.concat(F.lit(b""), F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"]).cast("string")), "").cast("binary")))


def stages_of(nodes: DataFrame, members: list[str], run: int, depth: int) -> list[DataFrame]:
    """Written blocks, stage by stage, until no tree has more than one."""
    size, out = run**depth, [written(blocks_of(nodes, members, run, depth))]
    while not (more := out[-1].filter(F.col("total") > size)).isEmpty():
        up = more.select("tree", F.col("block").alias("pos"), F.ceil(F.col("total") / size).alias("total"), F.col("root").alias("node"))
        out.append(written(blocks_of(up, [], run, depth)))
    return out


def above(stages: list[DataFrame], tops: DataFrame, run: int, depth: int) -> DataFrame:
    """tree, block and `path`, the siblings above the root of each block of the first stage.

    `tops` has tree and path for the root of each tree.
    """
    size, paths = run**depth, None
    for stage in reversed(stages):
        ends = stage.filter(F.col("total") <= size).select("tree", "block").join(tops, "tree")
        if paths is not None:
            ends = ends.unionByName(paths)
        if stage is stages[0]:
            return ends
        rows = stage.join(ends, ["tree", "block"])
        place = F.struct((F.col("block") * size + F.col("i")).alias("block"), F.concat(siblings(F.col("levels"), F.col("height"), F.col("i"), run), "path").alias("path"))
        paths = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("rows") - 1)).alias("i")).select("tree", place.alias("child")).select("tree", "child.*")


def manifest(docs: DataFrame, tampered: Column, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", run: int = RUN, depth: int = DEPTH) -> DataFrame:
    """One row for each row of docs: doc_id, leaf, subroot, root, path (left and right siblings by level) and changed leaf.

    `changed` is the leaf of the row as it stands when `tampered`, a column of texts, takes the place of its text.
    """
    other = [tampered if f == text_col else F.col(f) for f in fields]
    source = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    leaves = written(docs.select(source.alias("tree"), F.col(id_col).cast("long").alias("doc_id"), leaf_of([F.col(f) for f in fields]).alias("node"), leaf_of(other).alias("changed")))
    placed = numbered(leaves, ["doc_id", "node"])
    stages = stages_of(placed, ["doc_id", "changed"], run, depth)
    discard(leaves, placed)

    subroots = stages[0].filter(F.col("total") <= run**depth).select("tree", F.col("root").alias("node"))
    for stage in stages[1:]:
        subroots = subroots.unionByName(stage.filter(F.col("total") <= run**depth).select("tree", F.col("root").alias("node")))
    listed = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node"), ["source"])
    over = stages_of(listed, ["source"], run, depth)
    discard(listed)

    top = over[-1].filter(F.col("total") <= run**depth).select("tree", F.col("root").alias("whole"))
    nothing = F.array().cast("array<struct<left:binary,right:binary>>")
    upper = above(over, top.select("tree", nothing.alias("path")), run, depth).join(over[0], ["tree", "block"])
    sources = upper.select("path", "levels", "height", F.posexplode("rows").alias("i", "row"))
    sources = sources.select(F.col("row.source").alias("tree"), F.col("row.node").alias("subroot"), F.concat(siblings(F.col("levels"), F.col("height"), F.col("i"), run), "path").alias("path"))
    paths = above(stages, sources.select("tree", "path"), run, depth)

    full = stages[0].join(paths.withColumnRenamed("path", "up"), ["tree", "block"]).join(sources.select("tree", "subroot"), "tree").crossJoin(F.broadcast(top.select("whole")))
    proofs = F.transform("rows", lambda row, i: F.struct(
        row["doc_id"].alias("doc_id"), row["node"].alias("leaf"), row["changed"].alias("changed"),
        F.concat(siblings(F.col("levels"), F.col("height"), i, run), F.col("up")).alias("path"),
    ))
    return full.select(F.explode(proofs).alias("row"), "subroot", F.col("whole").alias("root")).select("row.doc_id", "row.leaf", "subroot", "root", "row.path", "row.changed")


def op11_merkle_manifest(docs: DataFrame) -> DataFrame:
    """Per document its leaf, subroot, root, the digest of its proof, and the root that a tampered leaf folds into."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    out = manifest(docs, F.when(chosen, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    out = out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(F.col("changed"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD_SQL = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD_SQL.format(f) for f in (*FIELDS[:-1], text)) + ")"


def _crc_sql(text: str) -> str:
    table = list(range(256))
    for _ in range(8):
        table = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in table]
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, x: xor(c >> 8, ({table})[(xor(c, x) & 255) + 1])), 4294967295)"


ORACLE_SQL = f"""
    WITH RECURSIVE leaves AS (
        SELECT source, doc_id, {_leaf_sql("text")} AS leaf,
               {_leaf_sql(f"CASE WHEN {_crc_sql('doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS changed
        FROM documents),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
    tree AS (
        SELECT 0 AS level, source, pos, n, leaf AS node FROM placed
        UNION ALL
        SELECT level + 1, source, pos // {RUN}, (n + {RUN - 1}) // {RUN}, sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY level, source, pos // {RUN}, n),
    subroots AS (
        SELECT source, level AS height, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
    upper_tree AS (
        SELECT 0 AS level, pos, n, subroot AS node FROM subroots
        UNION ALL
        SELECT level + 1, pos // {RUN}, (n + {RUN - 1}) // {RUN}, sha256(string_agg(node, '' ORDER BY pos)) FROM upper_tree WHERE n > 1 GROUP BY level, pos // {RUN}, n),
    beside AS (
        SELECT a.level, a.source, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
        FROM tree a JOIN tree b ON a.level = b.level AND a.source IS NOT DISTINCT FROM b.source AND a.pos // {RUN} = b.pos // {RUN}
        WHERE a.n > 1 GROUP BY a.level, a.source, a.pos),
    upper_beside AS (
        SELECT a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
        FROM upper_tree a JOIN upper_tree b ON a.level = b.level AND a.pos // {RUN} = b.pos // {RUN}
        WHERE a.n > 1 GROUP BY a.level, a.pos),
    climb AS (
        SELECT 0 AS step, false AS above, source, doc_id, leaf, pos AS start, pos, n, changed AS node, '' AS proof FROM placed
        UNION ALL
        SELECT step + 1, c.above OR c.n = 1, c.source, doc_id, leaf, start,
               CASE WHEN c.above THEN c.pos // {RUN} WHEN c.n = 1 THEN s.pos ELSE c.pos // {RUN} END,
               CASE WHEN c.above THEN (c.n + {RUN - 1}) // {RUN} WHEN c.n = 1 THEN s.n ELSE (c.n + {RUN - 1}) // {RUN} END,
               CASE WHEN c.above THEN sha256(u.before || c.node || u.after) WHEN c.n = 1 THEN c.node ELSE sha256(b.before || c.node || b.after) END,
               proof || CASE WHEN c.above THEN u.before || u.after WHEN c.n = 1 THEN '' ELSE b.before || b.after END
        FROM climb c JOIN subroots s ON c.source IS NOT DISTINCT FROM s.source
        LEFT JOIN beside b ON NOT c.above AND b.source IS NOT DISTINCT FROM c.source AND b.level = c.step AND b.pos = c.pos
        LEFT JOIN upper_beside u ON c.above AND u.level = c.step - s.height - 1 AND u.pos = c.pos
        WHERE NOT c.above OR c.n > 1)
    SELECT c.doc_id, leaf, s.subroot, t.node AS root, sha256(proof) AS proof_sha256, c.node AS folded_root, c.node = t.node AS verified
    FROM climb c JOIN subroots s ON c.source IS NOT DISTINCT FROM s.source, (SELECT node FROM upper_tree WHERE n = 1) t
    WHERE c.above AND c.n = 1
"""
