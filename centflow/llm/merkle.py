"""A Merkle manifest of a table as a content-addressed graph, and proofs by descent.

Every row is a leaf: the digest of its columns, each with its length. The rows of a group, in the order of a column,
are the leaves of a tree; every ``FANOUT`` consecutive nodes have one parent, whose digest is that of theirs in
order. The roots of the groups are the leaves of one more tree, whose root names the whole dataset. What is stored
is one record per distinct digest: the digests of its children. Equal subtrees share their records.

A proof is found without asking for parents. Requests (group and rank) descend from the root: at each level the
record of a digest gives its children, the next digit of the rank in base ``FANOUT`` chooses one, and the others
are collected. Requests with common digits descend as one row until their paths part, so a level joins as many rows
with the records as there are distinct paths, at most 1/16 of the leaves. The collected segments lie from the root
down; reversed they are the proof from the leaf up, and folding a leaf with them gives the root again.

Leaves are ranked by ``ranks.ranked``: a group that holds most rows spans many tasks. A level of a tree is one
aggregation of at most ``FANOUT`` rows a group. The driver learns the heights and the root only.

Defined results: a null value is a value of its own; a null group comes first, null ids come first in their group;
rows with equal ids are ordered by their digests, equal rows are leaves of their own with equal digests; an empty
table has no root and no proofs; a table of one row has its leaf as root and an empty proof. Texts of any length
are hashed whole. Only the named columns are read, so further columns do not matter.
"""

from dataclasses import dataclass
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from centflow.llm.ranks import ranked
from centflow.session import written

FANOUT = 16


@dataclass
class Manifest:
    """Stored parts of a manifest.

    leaves: tree, rank, leaf and what the caller carries along; trees: tree, place, height and subroot of each
    group; records: digest, children; root: the digest of all, None if there are no rows.
    """

    leaves: DataFrame
    trees: DataFrame
    records: DataFrame
    root: str | None
    top_height: int
    height: int


def field(value: Column) -> Column:
    """``-`` for a null, else the number of bytes, a colon and the value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the fields of a row."""
    return F.sha2(F.concat(*map(field, values)), 256)


def joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def build(rows: DataFrame, group: str, order: str) -> Manifest:
    """The manifest of rows with a column ``leaf``; all their columns stay with the leaves."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    # the row number tells equal rows apart, so that any number of them is split between tasks
    named = written(rows.withColumns({"tree": tree, "_row": F.monotonically_increasing_id()}), "leaves")
    leaves = written(ranked(named, ["tree"], [order, "leaf", "_row"]).drop("_row"), "ranked-leaves")
    sizes = written(leaves.groupBy("tree").agg(F.count("*").alias("rows")), "trees")
    trees = written(ranked(sizes, [], ["tree"], "place").withColumn("height", _height(F.col("rows"))), "placed-trees")
    count, height = trees.agg(F.count("*"), F.max("height")).first()
    if not count:
        empty = leaves.sparkSession.createDataFrame([], "digest string, children array<string>")
        return Manifest(leaves, trees.withColumn("subroot", F.lit(None).cast("string")), empty, None, 0, 0)
    nodes = leaves.join(trees, "tree").select("tree", F.col("rank").alias("pos"), "height", F.col("leaf").alias("digest"))
    subroots, below = _grow(nodes, height)
    trees = written(trees.join(subroots, "tree"), "subroots")
    top_height = _least_height(count)
    top = trees.select(F.lit("").alias("tree"), F.col("place").alias("pos"), F.lit(top_height).alias("height"),
                       F.col("subroot").alias("digest"))
    roots, above = _grow(top, top_height)
    levels = [*below, *above]
    records = leaves.sparkSession.createDataFrame([], "digest string, children array<string>")
    if levels:
        # equal digests are equal records
        all_ = reduce(DataFrame.unionByName, levels).groupBy("digest").agg(F.first("children").alias("children"))
        records = written(all_, "records")
    return Manifest(leaves, trees, records, roots.first()["subroot"], top_height, height)


def _least_height(leaves: int) -> int:
    height = 0
    while FANOUT ** height < leaves:
        height += 1
    return height


def _height(rows: Column) -> Column:
    """The levels above ``rows`` leaves, without the rounding of a logarithm."""
    levels = (rows > F.lit(FANOUT ** n) for n in range(63 // 4 + 1))
    return reduce(Column.__add__, (level.cast("int") for level in levels))


def _grow(nodes: DataFrame, height: int) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (tree, subroot) over nodes (tree, pos, height, digest), and the records of every level."""
    roots, records = [nodes.where("height = 0")], []
    for level in range(1, height + 1):
        child = F.struct("pos", "digest")
        parents = (nodes.where(F.col("height") >= level).groupBy("tree", "height", F.expr(f"pos div {FANOUT}").alias("up"))
                   .agg(F.sort_array(F.collect_list(child))["digest"].alias("children")))
        nodes = written(parents.select("tree", F.col("up").alias("pos"), "height", F.sha2(joined(F.col("children")), 256)
                                       .alias("digest"), "children"), f"level-{level}")
        roots.append(nodes.where(F.col("height") == level))
        records.append(nodes.select("digest", "children"))
    subroots = [r.select("tree", F.col("digest").alias("subroot")) for r in roots]
    return reduce(DataFrame.unionByName, subroots), records


def _chosen(children: Column, digit: Column) -> tuple[Column, Column]:
    """The child that a digit chooses, and what lies left and right of it."""
    others = F.struct(joined(F.slice(children, 1, digit)).alias("left"),
                      joined(F.slice(children, digit + 2, FANOUT)).alias("right"))
    return F.element_at(children, digit + 1), others


def _descend(paths: DataFrame, records: DataFrame, wanted: DataFrame) -> DataFrame:
    """One level down: paths (tree, pos, height, digest, segments) of which ``wanted`` (tree, pos) tells the next ones."""
    next_ = wanted.select("tree", F.col("pos").alias("_to"), F.expr(f"pos div {FANOUT}").alias("pos"))
    met = paths.join(records, "digest").join(next_, ["tree", "pos"])
    child, others = _chosen(F.col("children"), F.expr(f"cast(_to % {FANOUT} as int)"))
    return met.select("tree", F.col("_to").alias("pos"), "height", child.alias("digest"),
                      F.concat("segments", F.array(others)).alias("segments"))


def _prefixes(wanted: DataFrame, digits: int) -> DataFrame:
    """The distinct paths that are left when the last ``digits`` digits are taken away."""
    return wanted.select("tree", F.expr(f"pos div {FANOUT ** digits}").alias("pos")).distinct() if digits else wanted


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (tree, rank and further columns), each with the digest ``found`` at its path, its tree's ``subroot``
    and its ``proof``: an array of (left, right), the concatenated siblings of each level from the leaf to the root.
    """
    none = F.array().cast("array<struct<left:string,right:string>>")
    if manifest.root is None:
        return requests.limit(0).withColumns({"found": F.lit(None).cast("string"), "subroot": F.lit(None).cast("string"), "proof": none})
    # the bottom paths of all requests; those further up are prefixes of these
    paths_wanted = written(requests.select("tree", F.expr(f"rank div {FANOUT}").alias("pos")).distinct(), "wanted")
    asked = manifest.trees.join(paths_wanted.select("tree").distinct(), "tree")
    places = asked.select(F.lit("").alias("tree"), F.col("place").alias("pos"))
    paths = requests.sparkSession.createDataFrame(
        [("", 0, manifest.top_height, manifest.root, [])],
        "tree string, pos long, height int, digest string, segments array<struct<left:string,right:string>>")
    for left in range(manifest.top_height - 1, -1, -1):
        paths = _descend(paths, manifest.records, _prefixes(places, left))
    starts = written(asked.drop("subroot").join(paths.select(F.col("pos").alias("place"), "digest", "segments"), "place")
                     .select("tree", F.lit(0).cast("long").alias("pos"), "height", "digest", "segments",
                             F.col("digest").alias("subroot")), "subtrees")
    subroots = starts.select("tree", "subroot")
    starts = starts.drop("subroot")
    # trees join the descent at their own height; a path stops one level above the leaves
    paths = starts.where(F.col("height") == manifest.height)
    for left in range(manifest.height - 1, 0, -1):
        down = _descend(paths, manifest.records, _prefixes(paths_wanted, left - 1))
        paths = down.unionByName(starts.where(F.col("height") == left))
    if manifest.height > 0:
        paths = paths.unionByName(starts.where("height = 0"))
    bottoms = paths.join(manifest.records, "digest", "left")
    child, others = _chosen(F.col("children"), F.expr(f"cast(rank % {FANOUT} as int)"))
    alone = F.col("height") == 0
    met = (requests.withColumn("pos", F.expr(f"rank div {FANOUT}"))
           .join(bottoms.select("tree", "pos", "height", "digest", "segments", "children"), ["tree", "pos"])
           .join(subroots, "tree"))
    found = F.when(alone, F.col("digest")).otherwise(child)
    segments = F.when(alone, F.col("segments")).otherwise(F.concat("segments", F.array(others)))
    return met.select(*requests.columns, found.alias("found"), "subroot", F.reverse(segments).alias("proof"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]), 256))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return joined(F.flatten(F.transform(proof, lambda level: F.array(level["left"], level["right"]))))


def audit(docs: DataFrame, tampered: Column, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
          group: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's leaf, subroot, root, proof digest and the root that its leaf folds to; where ``tampered`` (null
    counts as false) holds, the folded leaf is that of the row with its text in lower case.
    """
    changed = [lower_ascii(F.col(c)) if c == text else F.col(c) for c in columns]
    rows = docs.select(F.col(group).alias("group"), F.col(order).alias("id"), digest(*map(F.col, columns)).alias("leaf"),
                       F.when(tampered, digest(*changed)).alias("tampered_leaf"))
    manifest = build(rows, "group", "id")
    proven = prove(manifest, manifest.leaves.select("tree", "rank", "id", "tampered_leaf"))
    folded = fold(F.coalesce("tampered_leaf", "found"), F.col("proof"))
    root = F.lit(manifest.root).cast("string")
    return proven.select(
        F.col("id").alias(order), F.col("found").alias("leaf"), "subroot", root.alias("root"),
        F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
