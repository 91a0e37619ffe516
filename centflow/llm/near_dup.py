"""Near-duplicate documents: MinHash bands find candidates, sequential Bayesian tests prune them, full sets decide.

A document is the set of its distinct shingles, windows of ``shingle`` words (``[^\\x20\\x09-\\x0D]+``, A-Z
lower-cased); a text with fewer words is one shingle, a text without words has the empty set. Two documents are
linked if 100 * |intersection| >= percent * |union|; documents with the empty set are linked with nothing.

1. One pass over the texts gives each document's set size, a 128-bit digest of its set, its bands and its
   signature. Documents with equal sets become one node, so exact copies never meet each other.
2. Nodes that share a band are candidates. ``rows`` values make a band, and there are enough bands that a pair at
   the threshold shares none with a probability of at most ``miss``.
3. Candidates are tested by batches of signature values: a pair goes when the posterior probability (from a
   uniform prior) that it reaches the threshold falls below ``miss``. Full sets decide about the rest.
4. Pairs come in rounds, and a pair whose nodes are connected by then is not tested: each node with one pivot,
   then all nodes of a bucket with its pivot. So a group of mutual copies costs a few pairs per member instead of
   all. Nodes of buckets that are not connected then are compared by families (nodes that buckets connect), block
   against block inside tasks: signatures first, then full sets, and only links that connect something come out.

Defined results: rows of one id are documents of their own that share the id; a null id never names a component
unless all its documents have none; a null text is empty. Further columns do not matter. An empty table gives no
rows.
"""

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from centflow.llm.batches import as_lists, slices, words
from centflow.llm.components import connected
from centflow.session import written

#: Nodes in a block of those that are compared with each other in one task.
BLOCK = 512
_SHINGLES_AT_ONCE = 1 << 17
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


@dataclass(frozen=True)
class Rule:
    """What links two documents, and how sure the search is to find it."""

    shingle: int = 5
    percent: int = 80
    rows: int = 5
    miss: float = 1e-5

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def factors(self) -> np.ndarray:
        return np.random.default_rng(20240501).integers(0, 1 << 63, self.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def least_matches(self, step: int = 16) -> list[tuple[int, int]]:
        """(values compared, matches below which a pair goes) after each batch of ``step`` values.

        With m of n equal and a uniform prior, the posterior probability of similarity t or more is that of at
        most m successes in n + 1 trials with chance t.
        """
        t, out = self.percent / 100, []
        for n in [*range(step, self.hashes, step), self.hashes]:
            below, m = 0.0, -1
            while below < self.miss and m < n:
                m += 1
                below += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of all texts in one array, and their number per text."""
    codes, distinct, n_words = words(texts, lower=True)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))[codes]
    starts = np.cumsum(n_words) - n_words
    weights = np.random.default_rng(7).integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n_windows = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    sums = np.zeros(len(hashes), np.uint64)
    for j in range(k):
        sums += padded[j:j + len(hashes)] * weights[j]
    first = np.repeat(starts, n_windows) + np.arange(int(n_windows.sum())) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    found = sums[first]
    ends = np.cumsum(n_windows)
    for i in np.flatnonzero((n_words > 0) & (n_words < k)).tolist():
        own = hashes[starts[i]:starts[i] + n_words[i]]
        found[ends[i] - 1] = (own * weights[:len(own)]).sum(dtype=np.uint64) + np.uint64(n_words[i])
    found = _mix(found)
    for a, b in zip((ends - n_windows).tolist(), ends.tolist()):
        if b - a > 1:
            found[a:b].sort()
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    new[(ends - n_windows)[n_windows > 0]] = True
    sizes = np.diff(np.concatenate([[0], np.cumsum(new)])[np.concatenate([[0], ends])])
    return found[new], sizes


def signatures(shingles: np.ndarray, sizes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits) of the sets that are not empty: sets x hashes."""
    sizes = sizes[sizes > 0]
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), len(factors)), np.uint32)
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + _SHINGLES_AT_ONCE)))
        stop = starts[last] if last < len(starts) else len(shingles)
        part, at = shingles[starts[first]:stop], starts[first:last] - starts[first]
        for j, factor in enumerate(factors):
            out[first:last, j] = np.minimum.reduceat(part * factor, at) >> np.uint64(32)
        first = last
    return out


_ROW_KEY = ("id", "k1", "k2")


def _row_key(id_column: str, text_column: str) -> list[Column]:
    """What tells rows apart: id and 128 bits of the text."""
    text = F.col(text_column).cast("string")
    return [F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def describe(df: DataFrame, rule: Rule, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, k1, k2, n, d1, d2, bands, signature) of every row: keys of the text, set size, digest of the set, band keys, signature."""
    rows = df.select(*_row_key(id_column, text_column), F.col(text_column).cast("string").alias("text"))
    factors = rule.factors()
    salts = np.random.default_rng(11).integers(0, 1 << 63, (rule.bands, rule.rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            shingles, sizes = shingle_sets(batch.column("text"), rule.shingle)
            values = signatures(shingles, sizes, factors)
            keys = _mix((values.reshape(len(values), rule.bands, rule.rows).astype(np.uint64) * salts).sum(2, dtype=np.uint64)
                        + np.arange(rule.bands, dtype=np.uint64)).view(np.int64)
            short, ends, row = values.astype(np.uint16), np.cumsum(sizes).tolist(), 0
            digests, bands, signed = [], [], []
            for end, size in zip(ends, sizes.tolist()):
                d = xxhash.xxh3_128_digest(shingles[end - size:end].tobytes())
                digests.append(d)
                bands.append(keys[row] if size else None)
                signed.append(short[row].tobytes() if size else None)
                row += size > 0
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in _ROW_KEY}, "n": pa.array(sizes, pa.int64()), "d1": pa.array(both[:, 0]),
                "d2": pa.array(both[:, 1]), "bands": pa.array(bands, pa.list_(pa.int64())),
                "signature": pa.array(signed, pa.binary())})

    return rows.mapInArrow(run, "id long, k1 long, k2 long, n long, d1 long, d2 long, bands array<long>, signature binary")


def _likely(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) that pass the sequential test of their signatures."""
    limits = rule.least_matches()
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("signature").alias(f"s{name}"))

    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                           for c in ("sa", "sb"))
            alive, matches, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in limits:
                matches[alive] += (left[alive, done:n] == right[alive, done:n]).sum(1)
                alive, done = alive[matches[alive] >= least], n
            yield pa.RecordBatch.from_arrays([c.take(pa.array(alive)) for c in batch.select(["a", "b"]).columns], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long")


def _sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """(node, shingles) of the wanted nodes; ``docs`` (id, text) is read again for them."""
    wanted = nodes.join(wanted.select("node").distinct(), "node").select("node", "label", "d1", "d2")

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            shingles, sizes = shingle_sets(batch.column("text"), rule.shingle)
            ends = np.cumsum(sizes)
            digests = [xxhash.xxh3_128_digest(shingles[e - n:e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist())]
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"d1": pa.array(both[:, 0]), "d2": pa.array(both[:, 1]),
                                              "shingles": as_lists(shingles.view(np.int64), sizes, pa.int64())})

    named = wanted.select(F.col("label").alias("named")).distinct()
    texts = docs.join(named, F.col("id").eqNullSafe(F.col("named")), "left_semi")
    return written(texts.mapInArrow(sets, "d1 long, d2 long, shingles array<long>").join(wanted, ["d1", "d2"])
                   .groupBy("node").agg(F.first("shingles").alias("shingles")), "shingle-sets")


def _linked(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"s{name}"))

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            x_all, y_all = (batch.column(c).values.to_numpy() for c in ("sa", "sb"))
            x_at, y_at = (batch.column(c).offsets.to_numpy() for c in ("sa", "sb"))
            for i in range(batch.num_rows):
                x, y = x_all[x_at[i]:x_at[i + 1]], y_all[y_at[i]:y_at[i + 1]]
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                good.append(100 * both >= rule.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(decide, "a long, b long")


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs that no links connect so far."""
    if labels is None:
        return pairs
    side = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"l{name}"))
    return (pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
            .where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b"))


def components(df: DataFrame, rule: Rule, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; ``component_id`` is the smallest id of its component."""
    return _named(*_connected(df, rule, id_column, text_column))


def _connected(df: DataFrame, rule: Rule, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The described rows, the nodes and the (node, label) of those that links connect."""
    docs = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    rows = written(describe(docs, rule, "id"), "signatures")
    nodes = written(
        rows.where("n > 0").groupBy("d1", "d2")
        .agg(F.min("id").alias("label"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("key"))
    pivots = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last")
    buckets = written(banded.join(pivots.select("key", "pivot"), "key"), "buckets")

    sets = _sets(buckets, nodes, docs, rule)
    labels, found = None, []
    for propose in (_first_pivots, _pivots):
        pairs = _apart(propose(buckets, labels), labels)
        likely = written(_likely(pairs, nodes, rule), "likely")
        found.append(written(_linked(likely, sets, rule), "found"))
        labels = written(connected(reduce(DataFrame.union, found)), "labels")
    rest = written(_mixed(buckets, labels), "unconnected")
    stars = rest.join(rest.groupBy("key").agg(F.min("node").alias("least")), "key")
    families = written(connected(stars.select(F.col("node").alias("a"), F.col("least").alias("b"))), "families")
    members = (rest.select("node", "label").distinct()
               .join(families.select("node", F.col("label").alias("family")), "node")
               .join(sets, "node").join(nodes.select("node", "signature"), "node"))
    found.append(written(_compared(members, rule), "found"))
    return rows, nodes, written(connected(reduce(DataFrame.union, found)), "labels")


def _first_pivots(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Each node with the smallest pivot of its buckets."""
    return (buckets.where("node <> pivot").groupBy("node").agg(F.min("pivot").alias("b"))
            .select(F.col("node").alias("a"), "b"))


def _pivots(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Each node with the pivots of all its buckets."""
    return buckets.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label) of the buckets whose nodes no links connect so far."""
    known = (buckets.select("key", "node").join(labels, "node", "left")
             .select("key", "node", F.coalesce("label", "node").alias("label")))
    mixed = known.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    return known.join(mixed, "key")


def _compared(members: DataFrame, rule: Rule) -> DataFrame:
    """Links among the members (node, label, family, signature, shingles) of families, enough to connect them.

    Families of more than BLOCK nodes are dealt into blocks and compared block by block, smaller ones share a
    block. Only links between nodes that no links connect yet leave a task, fewer than it has nodes.
    """
    sizes = members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    bins = F.lit(max(1, -(-members.count() // BLOCK)))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    alone = F.struct(F.lit(-1).cast("long").alias("unit"), *(F.pmod(F.xxhash64("family"), bins).cast("long").alias(c) for c in "ij"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
                        lambda x: F.struct(F.col("family").alias("unit"), F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
    dealt = (members.join(sizes, "family").withColumn("block", block.cast("long"))
             .withColumn("of", F.explode(F.when(F.col("blocks") == 1, F.array(alone)).otherwise(pairs)))
             .select("of.*", "block", "family", "node", "label", "signature", "shingles"))
    limits = rule.least_matches()

    def compare(unit: pa.Table) -> pa.Table:
        unit = unit.combine_chunks()
        family, node, label, own = (unit[c].to_numpy() for c in ("family", "node", "label", "block"))
        apart = unit["i"][0].as_py() != unit["j"][0].as_py()
        values = np.frombuffer(b"".join(unit["signature"].to_pylist()), np.uint16).reshape(len(node), -1)
        lists = unit["shingles"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        shingles, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        parent = {x: x for x in label.tolist()}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        links = []
        for x in range(len(node)):
            y = np.flatnonzero((family[x + 1:] == family[x]) & (label[x + 1:] != label[x])) + x + 1
            y = y[own[y] != own[x]] if apart else y
            matches, done = np.zeros(len(y), np.int64), 0
            for n, least in limits:
                matches += (values[y, done:n] == values[x, done:n]).sum(1)
                y, matches, done = y[matches >= least], matches[matches >= least], n
            mine = shingles[at[x]:at[x + 1]]
            for other in y.tolist():
                a, b = root(int(label[x])), root(int(label[other]))
                if a == b:
                    continue
                theirs = shingles[at[other]:at[other + 1]]
                union = len(np.unique(np.concatenate([mine, theirs])))
                if 100 * (len(mine) + len(theirs) - union) >= rule.percent * union:
                    parent[a] = b
                    links.append((int(node[x]), int(node[other])))
        return pa.table({"a": pa.array([l[0] for l in links], pa.int64()), "b": pa.array([l[1] for l in links], pa.int64())})

    return dealt.groupBy("unit", "i", "j").applyInArrow(compare, "a long, b long")


def _named(rows: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Components by the smallest id of their documents."""
    joined = nodes.select("node", "d1", "d2", F.col("label").alias("least")).join(labels, "node", "left")
    joined = joined.withColumn("label", F.coalesce("label", "node"))
    names = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    sets = joined.join(names, "label").select("d1", "d2", "component_id")
    return (rows.select("id", "n", "d1", "d2").join(sets, ["d1", "d2"], "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")))


def keep(df: DataFrame, rule: Rule, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, that stay when exactly one row of each component does.

    Of a component a row with the smallest id stays (a null id only if all are null), of several the one with the
    least key of its text, and of rows with equal id and text any one. An id names nothing else: its other rows are
    decided by their own components. Documents without words are linked with nothing and all stay.
    """
    rows, nodes, labels = _connected(df, rule, id_column, text_column)
    own = nodes.select("node", "d1", "d2").join(labels, "node", "left").select("d1", "d2", F.coalesce("label", "node").alias("component"))
    members = rows.where("n > 0").select(*_ROW_KEY, "d1", "d2").join(own, ["d1", "d2"]).select("component", *_ROW_KEY)
    order = F.struct(F.col("id").isNull().alias("unnamed"), *_ROW_KEY)
    chosen = members.groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("size")).where("size > 1")
    decided = written(members.join(chosen, "component").groupBy(*_ROW_KEY)
                      .agg(F.count("*").alias("times"), F.bool_or(order == F.col("best")).alias("stays")), "decided")
    key = "_key"
    while key in df.columns:
        key += "_"
    keyed = df.select("*", F.struct(*_row_key(id_column, text_column)).alias(key))
    gone, again = decided.where("not stays or times > 1"), decided.where("stays and times > 1")
    # an aggregate with a map-side part, as one text may have any number of copies
    firsts = (keyed.join(again, _same_key(again, key), "left_semi").groupBy(key)
              .agg(F.first(F.struct(*(keyed[f"`{c}`"] for c in df.columns))).alias("_row")).select("_row.*"))
    return keyed.join(gone, _same_key(gone, key), "left_anti").drop(key).unionByName(firsts)


def _same_key(rows: DataFrame, key: str) -> Column:
    """Whether the key in a row's column ``key`` is that of the given rows."""
    return reduce(Column.__and__, (F.col(f"{key}.{c}").eqNullSafe(rows[c]) for c in _ROW_KEY))
