"""Find benchmark items in documents, also with a few edits: q-gram lemma in diagonal bands, then alignment.

Texts are compared as code points, lower-cased and with every run of white space as one space. An item of n
characters is found if a passage of the document is within ``EDITS`` * n edits of it. A passage within e edits
shares at least n + 1 - Q * (e + 1) q-grams with the item, on diagonals (place in the document minus place in the
item) no more than e apart from the passage's own. So hits are counted first by stretches of the document, then by
bands of 2 * (2e + 1) diagonals that overlap by half; regions that reach the bound are aligned, cell by cell of the
band, and those within the budget stay.

Items are taken ``ITEMS`` at a time, so the index that tasks carry has a bound whatever the size of the benchmark;
each block of items is one pass over the documents.

Defined results: null or empty texts, and items shorter than Q characters, match nothing; the edits of an item are
at most its length / Q - 1; of equally good passages the first one is reported; repeated rows are reported each;
null ids are kept as they are; only the named columns are read.
"""

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from centflow.llm.batches import gather, slices

Q, EDITS = 8, 0.1
ITEMS, STRETCH, SLICE = 2000, 512, 2 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def normalized(text: str | None) -> str:
    return " ".join((text or "").lower().replace("\0", " ").split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray) -> np.ndarray:
    n = len(points) - Q + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        wide = points.astype(np.uint64)
        for j in range(Q):
            out = out * _FACTOR + wide[j:j + n]
    return out * _FACTOR


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        items = [(i, n) for i, t in items if len(n := normalized(t)) >= Q]
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.points = [code_points(t) for t in self.texts]
        self.sizes = np.array([len(p) for p in self.points], np.int64)
        self.edits = np.minimum((self.sizes * EDITS).astype(np.int64), self.sizes // Q - 1)
        self.least = self.sizes + 1 - Q * (self.edits + 1)
        self.stride = 2 * self.edits + 1
        hashes = [gram_hashes(p) for p in self.points]
        counts = np.array([len(h) for h in hashes], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(flat, kind="stable")
        self.grams, self.first = np.unique(flat[order], return_index=True)
        self.times = np.diff(np.append(self.first, len(flat)))
        self.item = np.repeat(np.arange(len(items)), counts)[order]
        self.place = gather(np.zeros(len(items), np.int64), counts)[order]
        bits = max(16, (64 * len(self.grams)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self.grams >> self.shift] = True

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, stop, edits) of the best passage for every item found in normalized texts."""
        if not self.ids or not texts:
            return []
        points = code_points("\0".join(texts) + "\0" * Q)
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        hashes = gram_hashes(points)
        at = np.flatnonzero(self.seen[hashes >> self.shift])
        row = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        real = self.grams[row] == hashes[at]
        at, row = at[real], row[real]
        if not len(at):
            return []
        times = self.times[row]
        entry = gather(self.first[row], times)
        at, item, place = np.repeat(at, times), self.item[entry], self.place[entry]
        # stretches at least as long as any passage, so that a passage lies in two that follow each other
        stretch = max(STRETCH, int((self.sizes + self.edits).max()))
        # only stretches and items that share a gram are counted, so long texts take no more than their hits
        n_items = len(self.ids)
        keys, key, counts = np.unique(at // stretch * n_items + item, return_inverse=True, return_counts=True)
        with_next = counts + self._counts_at(keys, counts, keys + n_items)
        with_last = counts + self._counts_at(keys, counts, keys - n_items)
        good = (np.maximum(with_next, with_last) >= self.least[keys % n_items])[key]
        at, item, place = at[good], item[good], place[good]
        if not len(at):
            return []
        text = np.searchsorted(starts, at, side="right") - 1
        diagonal = at - starts[text] - place + self.sizes[item]  # of the text's first character: the item's size
        band = diagonal // self.stride[item]
        bands = np.stack([np.tile(text, 2), np.tile(item, 2), np.concatenate([band, band - 1])])
        order = np.lexsort(bands[::-1])
        bands = bands[:, order]
        new = np.flatnonzero(np.append(True, (bands[:, 1:] != bands[:, :-1]).any(0)))
        size = np.diff(np.append(new, bands.shape[1]))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for t, i, b in bands[:, new[size >= self.least[bands[1, new]]]].T.tolist():
            edits, width = int(self.edits[i]), int(self.sizes[i])
            low = b * int(self.stride[i]) - width
            first, last = max(0, low - edits), min(int(sizes[t]), low + 2 * int(self.stride[i]) + width + edits)
            if (t, i) in best and best[t, i][0] == 0:
                continue
            found = self._align(i, texts[t][first:last], edits)
            if found:
                found = found[0], found[1] + first, found[2] + first
                best[t, i] = min(best.get((t, i), found), found)
        return [(t, i, start, stop, edits) for (t, i), (edits, start, stop) in sorted(best.items())]

    @staticmethod
    def _counts_at(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The counts of some of the sorted keys, 0 where there is none."""
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, counts[at], 0)

    def _align(self, i: int, region: str, budget: int) -> tuple[int, int, int] | None:
        """(edits, start, stop) of the region's passage nearest to the item, if it is within the budget.

        One row of the alignment per character of the item; a cell holds edits and start in one number, so that
        the minimum prefers fewer edits, then the earlier start. Rows end early when no cell is in the budget.
        """
        exact = region.find(self.texts[i])
        if exact >= 0:
            return 0, exact, exact + len(self.texts[i])
        width = len(region) + 1
        one = 1 << 32
        steps = np.arange(width, dtype=np.int64) * one
        cells, letters = np.arange(width, dtype=np.int64), code_points(region)
        for letter in self.points[i]:
            following = cells + one
            following[1:] = np.minimum(following[1:], cells[:-1] + one * (letters != letter))
            cells = np.minimum.accumulate(following - steps) + steps
            if cells.min() >= (budget + 1) * one:
                return None
        stop = int(cells.argmin())
        edits, start = divmod(int(cells[stop]), one)
        return (edits, start, stop) if edits <= budget else None


def _blocks(benchmark: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items, ITEMS at a time, in the order of their ids."""
    items = benchmark.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    block: list[tuple[int, str]] = []
    for r in items.where("text is not null").distinct().orderBy("id", "text").toLocalIterator():
        block.append((r["id"], r["text"]))
        if len(block) == ITEMS:
            yield block
            block = []
    if block:
        yield block


def find(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, stop, edits) for every document and item found in it."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def search(items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items)
            for batch in slices(batches, "text", SLICE):
                found = index.matches([normalized(t) for t in batch.column("text").to_pylist()])
                numbers = np.array(found, np.int64).reshape(-1, 5).T
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").take(pa.array(numbers[0])),
                    "item_id": pa.array([index.ids[i] for i in numbers[1].tolist()], pa.int64()),
                    "start": pa.array(numbers[2]), "stop": pa.array(numbers[3]), "edits": pa.array(numbers[4])})

        kind = rows.schema["doc_id"].dataType.simpleString()
        return rows.mapInArrow(run, f"doc_id {kind}, item_id long, start long, stop long, edits long")

    passes = [search(items) for items in _blocks(benchmark, item_id, item_text)] or [search([])]
    return reduce(DataFrame.union, passes)


def keep(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_id: str = "item_id",
         item_text: str = "text") -> DataFrame:
    """The rows, with all their columns, that hold no item."""
    for items in _blocks(benchmark, item_id, item_text):
        def run(batches: Iterable[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = Index(items)
            for batch in slices(batches, text_column, SLICE):
                clean = np.ones(batch.num_rows, bool)
                for found in index.matches([normalized(t) for t in batch.column(text_column).to_pylist()]):
                    clean[found[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
