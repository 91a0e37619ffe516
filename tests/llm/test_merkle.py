"""Merkle manifests against a tree built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from centflow.llm import merkle
from compare import SF, connect, difference

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row_digest(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i:i + 16])) for i in range(0, len(last), 16)])
    return levels


def path_of(levels, at):
    """(left, right) of each level from the leaf up."""
    out = []
    for nodes in levels[:-1]:
        run = at // 16 * 16
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1:run + 16])))
        at //= 16
    return out


def by_hand(rows):
    """The expected rows of the audit, sorted by their text."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, row_digest(r, r["text"])))
    trees = {s: levels_of([row_digest(r, r["text"]) for r in groups[s]]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order]) if order else []
    out = []
    for place, s in enumerate(order):
        for at, r in enumerate(groups[s]):
            path = path_of(trees[s], at) + path_of(top, place)
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                text = text.translate(LOWER)
            node = row_digest(r, text)
            for left, right in path:
                node = sha(left + node + right)
            out.append((r["doc_id"], row_digest(r, r["text"]), trees[s][-1][0], top[-1][0],
                        sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def audited(df):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = merkle.audit(df, tampered)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, found.collect()), key=repr)


def with_sources(spark, df, rows):
    """The frame's schema with sources, languages and lengths that may be null."""
    full = [(i, t, lang, source, n, "x", None, "y", "z", None, "") for i, t, lang, source, n in rows]
    return spark.createDataFrame(full, df.schema)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert audited(docs) == by_hand(docs.collect())


def test_sql_twin(spark):
    name = "op11_merkle_manifest"
    assert difference(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) == ""


def test_edge_rows(spark, edge):
    assert audited(edge) == by_hand(edge.collect())


@pytest.mark.parametrize("sizes", [[1], [1, 1], [2], [16], [17], [1, 257, 16], [1] * 20 + [33]])
def test_heights(spark, edge, sizes, many_blocks):
    rows, n = [], 0
    for s, size in enumerate(sizes):
        source = None if s == 1 else f"s{s}é" if s % 2 else f"s{s}"
        for _ in range(size):
            rows.append((n * 7 % 1009, f"Text {n % 5} A", None if n % 3 else "en", source, n if n % 4 else None))
            n += 1
    df = with_sources(spark, edge, rows)
    assert audited(df) == by_hand(df.collect())


def test_equal_rows_are_leaves_of_their_own(spark, edge, many_blocks):
    rows = [(5, "Same Text", "en", "hot", 9)] * 300 + [(i, f"t{i}", "en", "hot", 2) for i in range(20)]
    df = with_sources(spark, edge, rows)
    assert audited(df) == by_hand(df.collect())
    manifest = merkle.build(df.select(F.col("source").alias("g"), F.col("doc_id").alias("i"),
                                      merkle.digest(F.col("doc_id"), F.col("text")).alias("leaf")), "g", "i")
    digests = manifest.records.select("digest")
    assert digests.count() == digests.distinct().count() < 25


def test_empty_table(spark, edge):
    assert audited(edge.limit(0)) == []


def test_requests_of_some_rows_only(spark, edge):
    rows = [(i, f"text {i}", "en", f"s{i % 3}", i) for i in range(700)]
    df = with_sources(spark, edge, rows)
    leaves = df.select(F.col("source").alias("g"), F.col("doc_id").alias("i"),
                       merkle.digest(F.col("doc_id"), F.col("text")).alias("leaf"))
    manifest = merkle.build(leaves, "g", "i")
    asked = manifest.leaves.where("i in (3, 4, 699)").select("tree", "rank", "i", "leaf")
    found = merkle.prove(manifest, asked).select("i", "leaf", "found", merkle.fold(F.col("found"), F.col("proof")).alias("root"))
    got = found.collect()
    assert {r["i"] for r in got} == {3, 4, 699}
    assert all(r["leaf"] == r["found"] and r["root"] == manifest.root for r in got)
