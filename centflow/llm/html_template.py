"""Main text of web pages by templates that are deduced from pages of one host.

A page's tokens are its closed elements and its pieces of text. An element has one token for each of its names (tag
with one class, id, role or itemprop name, digits counting as one), so that names which differ between pages do not
hide those that stay; an element left open has none on that page and does no harm to the other pages. A piece of text
is told apart by the tag it follows. Over the pages of a host every token has an occurrence vector, how often it is on
each page; tokens with equal vectors are an equivalence class. A class is valid if it holds an element and is on at
least ``SUPPORT`` of the host's pages (two at least); its elements are regions of the template, which nest as they do
on the page. Its texts are words of the template, too, if it is on at least ``TEXT_SUPPORT`` of the pages (three at
least): they come with the layout, page by page as often as it does. What lies between them fills the slots.

The slots inside the article (or else the main) region stay, of a page without one all; an article that is in the
template goes before one that is not. Outside of an article the template's texts go, unless nothing else is left of a
page; an article is kept whole. Last, regions that by their names are no part of an article (menus, footers, adverts,
forms, comments ...) go, in the template or not.

A vector is kept as sums of two 31-bit hashes of (page, count), so a host of any size is aggregated before the shuffle; a
host with fewer than two pages takes the template of all pages. Pages are joined with their host's template in
``SALTS`` parts, so a large host is spread. A template has at most 1 / ``SUPPORT`` times the tokens of an average page.

Defined results: a null or empty page, or one without text, gives an empty text; a null address is a host of its
own; repeated rows are pages of their own; null ids stay; further columns do not matter. Texts are whole.
"""

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from centflow.llm import html_page as hp
from centflow.llm.batches import slices

SUPPORT, TEXT_SUPPORT, SALTS = 0.3, 0.5, 32
#: The host that stands for all pages.
ANY = "*"
_LOW = (1 << 31) - 1
_HOST = r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def _token(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


@lru_cache(maxsize=10_000)
def name_tokens(key: str) -> frozenset[int]:
    """Tokens of an element, one for each of its names; they are even."""
    tag, *names = key.split(" ")
    attribute, told = "", []
    for name in names:
        start, equal, rest = name.partition("=")
        if equal and start in hp.ATTRIBUTES:
            attribute, name = start, rest
        told.append(f"{tag} {attribute}={name}")
    return frozenset(_token(name) & ~1 for name in told or [tag])


def text_tokens(parts: list[tuple[str, str, str]]) -> Iterator[tuple[int, int]]:
    """(place, token) of every piece of text, told apart by the tag before it; the tokens are odd."""
    before = ""
    for at, (kind, name, _) in enumerate(parts):
        if kind != "text":
            before = f"{kind} {name}"
        elif not name.isspace():
            yield at, _token(f"{before}\0{' '.join(name.split())}") | 1


def page_tokens(page: str) -> dict[int, int]:
    """How often each token is on the page."""
    parts, seen = list(hp.tokens(page)), {}
    for e in hp.elements(parts):
        if e.stop is not None:
            for token in name_tokens(e.key):
                seen[token] = seen.get(token, 0) + 1
    for _, token in text_tokens(parts):
        seen[token] = seen.get(token, 0) + 1
    return seen


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token: pages that have it and the summed vector."""
    for batch in slices(batches, "html"):
        sums: dict[tuple[str, int], list[int]] = {}
        for own, url, page in zip(*(batch.column(c).to_pylist() for c in ("host", "url", "html"))):
            seen = page_tokens(page or "")
            name = xxhash.xxh3_64_intdigest(f"{url}\0{page}")
            values = {times: xxhash.xxh3_64_intdigest(times.to_bytes(8, "little"), name) for times in set(seen.values())}
            for host in (own, ANY):
                for token, times in seen.items():
                    total = sums.setdefault((host, token), [0, 0, 0])
                    value = values[times]
                    total[0] += 1
                    total[1] += value >> 33
                    total[2] += value & _LOW
        yield pa.RecordBatch.from_pydict({
            "host": pa.array([h for h, _ in sums], pa.string()), "token": pa.array([t for _, t in sums], pa.int64()),
            **{name: pa.array([v[i] for v in sums.values()], pa.int64()) for i, name in enumerate(("pages", "high", "low"))}})


def deduce(pages: DataFrame) -> DataFrame:
    """(host, template array<bigint>) of pages (host, url, html): the tokens of each host's valid classes."""
    found = pages.select("host", "url", "html").mapInArrow(_counts, "host string, token long, pages long, high long, low long")
    vectors = found.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "high", "low"))).where("pages >= 2")
    sizes = pages.groupBy("host").agg(F.count("*").alias("of"))
    sizes = sizes.unionByName(sizes.agg(F.lit(ANY).alias("host"), F.sum("of").alias("of")))
    is_text = F.col("token").bitwiseAND(1) == 1
    often = F.when(is_text, (F.col("pages") >= 3) & (F.col("pages") >= TEXT_SUPPORT * F.col("of"))).otherwise(
        F.col("pages") >= SUPPORT * F.col("of"))
    classes = (vectors.join(sizes, "host").where(often).groupBy("host", "pages", "high", "low")
               .agg(F.collect_list("token").alias("tokens"), F.bool_or(~is_text).alias("valid")))
    return classes.where("valid").groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("template"))


def bounds_of(found: list[hp.Element], template: frozenset[int]) -> tuple[str, list[tuple[int, int]]]:
    """Kind and bounds of the article or else main regions among closed elements; those of asides only if no others."""
    asides, last = [], -1
    for e in found:
        if e.stop > last and hp.is_aside(e.key, False):
            asides.append((e.start, e.stop))
            last = e.stop
    mains = [(e, kind) for e in found if (kind := hp.is_main(e.key)) and not hp.is_aside(e.key, False)]
    apart = [(e, kind) for e, kind in mains if not any(a < e.start and e.stop < b for a, b in asides)]
    for pool in (apart, mains):
        for kind in ("article", "main"):
            own = [e for e, k in pool if k == kind]
            if own:
                known = [e for e in own if not template.isdisjoint(name_tokens(e.key))]
                return kind, [(e.start, e.stop) for e in known or own]
    return "", []


def main_text(page: str, template: frozenset[int]) -> str:
    """The slots of the article in a page with the given template."""
    parts = list(hp.tokens(page))
    found = [e for e in hp.elements(parts) if e.stop is not None]
    kind, bounds = bounds_of(found, template)
    kept, end = [], -1
    for start, stop in sorted(bounds):
        if start > end:
            kept.append((start, stop))
            end = stop
    holds_main = lambda e: any(e.start <= a and b <= e.stop for a, b in kept)
    inside = lambda e: any(a < e.start < b for a, b in kept)
    # a region that few other pages have, but that is closed on this one, is in no template and goes as well
    dropped = [(e.start, e.stop) for e in found if hp.is_aside(e.key, inside(e)) and not holds_main(e)]
    kept = kept or [(0, len(parts))]
    constant = [] if kind == "article" else [(at, at + 1) for at, token in text_tokens(parts) if token in template]
    return hp.blocks(parts, kept, dropped + constant) or hp.blocks(parts, kept, dropped)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"),
                        F.col(html_column).cast("string").alias("html"))
    keyed = rows.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit("")))).withColumn(
        "salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    templates = deduce(keyed)
    # one row, no longer than the tokens of a few pages
    general = [t for r in templates.where(F.col("host") == ANY).select("template").collect() for t in r["template"]]
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    joined = keyed.join(templates.select("host", "template", salts), ["host", "salt"], "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            known: dict[tuple, frozenset[int]] = {}
            texts = []
            for page, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist()):
                key = tuple(template) if template else tuple(general)
                texts.append(main_text(page or "", known.setdefault(key, frozenset(key))))
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()),
                "n_chars": pc.utf8_length(pa.array(texts, pa.string())).cast(pa.int64())})

    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "template").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
