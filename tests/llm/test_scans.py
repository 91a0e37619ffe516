"""License scans, near-duplicates, sharding, main text and the pipeline."""

import collections
import html
import random
import re
import time

import corpus_pipeline
import pytest

from centflow.llm import components, hash_ring, html_page, html_template, license_scan, near_dup, queries
from centflow.llm.batches import table

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def licenses(text):
    words = [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]
    near, out = collections.defaultdict(list), {}
    for name, notice in license_scan.TEMPLATES:
        own = notice.split()
        n, step = len(own), license_scan.stride(len(own))
        shingles = {tuple(own[i:i + 3]) for i in range(n - 2)}
        for a in range(0, len(words), step):
            window = words[a:a + n + step - 1]
            share = len(shingles & {tuple(window[i:i + 3]) for i in range(len(window) - 2)}) / len(shingles)
            if share >= license_scan.CONTAINED:
                near[n].append((a, share, name))
    for found in near.values():
        for a, share, name in found:
            if share == max(s for b, s, _ in found if abs(a - b) <= license_scan.NEAR):
                best = out.get(name, (0, 0))
                out[name] = max(best, (share, -a))
    return {k: (round(s, 9), -a) for k, (s, a) in out.items()}


def test_licenses_equal_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    expected = {(r["doc_id"], k): v for r in docs.collect() for k, v in licenses(r["text"]).items()}
    found = queries.op1_license_scan(spark, "/root/testdata/sf0.01").collect()
    assert {(r["doc_id"], r["license"]): (round(r["containment"], 9), r["first_word"]) for r in found} == expected and expected


def test_license_scan_is_native_and_takes_edge_cases(edge, frame):
    plan = license_scan.scan(edge)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert license_scan.scan(edge).count() == 0 and license_scan.scan(frame([])).count() == 0
    found = license_scan.scan(frame([(1, "Foo.\nAll rights reserved."), (1, "x All Rights RESERVED x"), (None, "all rights reserved")]))
    assert {(r["doc_id"], r["license"], r["n_windows"]) for r in found.collect()} == {
        (1, "All-Rights-Reserved", 1), (None, "All-Rights-Reserved", 1)}


def test_licenses_of_rows_with_one_id(frame):
    """Positions of different texts are not compared, whatever their ids; equal rows are one."""
    notice = {n: t for n, t in license_scan.TEMPLATES}
    gpl3, gpl2 = notice["GPL-3.0"], notice["GPL-2.0"].replace(" as ", " ", 1)
    apart = {(r.doc_id, r.license) for r in license_scan.scan(frame([(1, gpl3), (2, gpl2)])).collect()}
    assert {name for _, name in apart} == {"GPL-3.0", "GPL-2.0"}
    for i in (7, None):
        found = license_scan.scan(frame([(i, gpl3), (i, gpl2)] + [(i, gpl3)] * 30)).collect()
        assert {(r.doc_id, r.license) for r in found} == {(i, name) for _, name in apart}
        assert all(r.n_windows == n for r in found for n in [x.n_windows for x in license_scan.scan(frame([(1, notice[r.license] if r.license == "GPL-3.0" else gpl2)])).collect() if x.license == r.license])


def test_licenses_of_like_words(frame):
    notice = "the GNU {} Public License as published by the Free Software Foundation; either version {} of the License, or later"
    cases = {"GPL-1.0": ("General", "1"), "GPL-2.0": ("General", "2"), "GPL-3.0": ("General", "3"), "LGPL-2.0": ("Library General", "2"),
             "LGPL-2.1": ("Lesser General", "2.1"), "LGPL-3.0": ("Lesser General", "3"), "AGPL-3.0": ("Affero General", "3")}
    texts = {name: "Foo " * i + notice.format(*words) for i, (name, words) in enumerate(cases.items())}
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License"
    texts |= {"CC-BY-4.0": cc.format(""), "CC-BY-NC-4.0": cc.format("-NonCommercial")}
    names = list(texts)
    found = license_scan.scan(frame([(i, texts[name]) for i, name in enumerate(names)])).collect()
    assert {(names[r["doc_id"]], r["license"]) for r in found} == {(name, name) for name in names} and len(found) == len(names)


def shingles(text, k):
    words = WORD.findall((text or "").translate(UPPER))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute_components(rows, k, percent):
    """Smallest id of each row's component, by comparing all sets that share a shingle."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    index = collections.defaultdict(list)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for g in s for j in index[g])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for g in s:
            index[g].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows)]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, percent):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    found = near_dup.components(table(spark, "/root/testdata/sf0.01", "documents"), near_dup.Rule(k, percent))
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute_components(rows, k, percent))


def test_group_of_near_copies(spark, frame, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 20)
    random.seed(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(random.randint(0, 6)):
            words[random.randrange(120)] = f"v{random.random()}"
        rows.append((1000 - i, " ".join(words)))
    found = near_dup.components(frame(rows), near_dup.Rule(3, 85))
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute_components(rows, 3, 85))


def test_near_duplicate_edge_cases(edge, frame):
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.components(edge, near_dup.Rule(3, 85)).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (None, 1, 4), (None, 0, None), (10, 1, 10), (11, 1, 10)} <= found
    assert {c for i, _, c in found if i in (6, 7)} == {6}
    kept = near_dup.keep(edge, near_dup.Rule(3, 85))
    assert set(kept.columns) == set(edge.columns)
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 8, 9, 10]
    assert near_dup.components(frame([]), near_dup.Rule()).count() == 0


def test_rows_are_kept_by_their_own_texts(frame):
    """Ids that repeat with other texts, near copies that share an id, copies without an id."""
    texts = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"}
    near = {k: t + " end" for k, t in texts.items()}
    rows = [(1, texts["a"]), (7, near["a"]), (7, texts["b"]), (8, texts["c"]), (8, near["c"]), (None, texts["d"]),
            (None, texts["d"]), (None, near["d"]), (None, texts["e"]), (9, near["e"]), (5, texts["f"]), (5, texts["f"]),
            (5, ""), (5, ""), (None, None)]
    kept = near_dup.keep(frame(rows), near_dup.Rule(3, 85))
    found = collections.Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert kept.columns == frame(rows).columns
    assert found[5, ""] == 2 and found[None, None] == 1
    full = collections.Counter((i, t[0]) for i, t in found.elements() if t)
    assert full == {(1, "a"): 1, (7, "b"): 1, (8, "c"): 1, (None, "d"): 1, (9, "e"): 1, (5, "f"): 1}


def test_kept_rows_may_have_a_column_named_like_the_key(frame):
    docs = frame([(1, "one two three four five six"), (2, "one two three four five six"), (3, "other words")])
    named = docs.withColumnsRenamed({"label": "_key", "words": "_key_"})
    kept = near_dup.keep(named, near_dup.Rule(shingle=5, percent=80))
    assert kept.columns == named.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_bands_and_tests_miss_little():
    rule = near_dup.Rule(3, 85)
    assert (1 - 0.85 ** rule.rows) ** rule.bands <= rule.miss
    assert all(0 < m < n * 0.85 for n, m in rule.least_matches())


def test_connected_components(spark):
    random.seed(5)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    found = dict(tuple(r) for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(found[x] == root(x) for e in links if e[0] != e[1] for x in e)


def test_shards_differ_by_one_row(spark):
    found = queries.op6_sharding(spark, LARGER)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    slots = collections.defaultdict(list)
    for r in found.collect():
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and sum(map(len, slots.values())) == 10_000


def test_shards_of_repeated_rows(spark, frame):
    same = frame([(1, "a")] * 1000 + [(None, None)] * 500 + [(i, "b") for i in range(100)])
    found = hash_ring.assign(same, "doc_id", ["text"], 7).collect()
    sizes = collections.Counter(r["shard"] for r in found)
    assert len(found) == 1600 and max(sizes.values()) - min(sizes.values()) <= 1
    assert len({(r["shard"], r["slot"]) for r in found}) == 1600
    assert hash_ring.assign(frame([]), "doc_id", ["text"], 7).count() == 0


def test_ring_moves_little_when_it_grows():
    loads = {part: 3 for part in range(hash_ring.CELLS * hash_ring.PARTS)}
    where = lambda shards: {(s.part, i): s.shard for s in hash_ring.place(loads, shards, slack=0.25) for i in range(s.first, s.first + s.count)}
    before, after = where(8), where(9)
    moved = sum(before[k] != after[k] for k in before)
    assert moved < 0.3 * len(before)


def test_main_text_of_pages(spark):
    pages = {r["page_id"]: r["html"] for r in table(spark, "/root/testdata/sf0.01", "pages").collect()}
    found = queries.op9_main_text(spark, "/root/testdata/sf0.01").collect()
    for r in found:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", "\n", article))
        assert r["text"] == " ".join(html.unescape(plain).split()) and r["n_chars"] == len(r["text"])
    assert len(found) == len(pages)


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><header class="site"><h2>Site</h2></header>
<nav><ul><li>Home</li></ul></nav><div id="cookie-notice">We use cookies</div><div class="content"><article><header><h1>Title {0}</h1></header>
<p>One &amp; two<b>bold</b> text.<br>Next&nbsp;line <script>var x = "</p>";</script></p><p>Last {0}
para</p><aside>Related</aside><form>Name <input></form><section id="comments"><p>First!</p></section></article></div>
<div class="sidebar">Side</div><!-- note --><footer>Foot</footer></body></html>"""


def test_regions_that_are_no_article(spark):
    schema = "page_id long, url string, html string, text string, host string"
    rows = [(i, f"https://a.example/{i}", PAGE.format(i), "x", "y") for i in range(5)]
    rows += [(9, None, None, "x", "y"), (10, "b.example", "", "x", "y"), (None, "//c.example/x", "<p>Plain <i>te</i>xt</p><p>More", "x", "y"),
             (0, "https://a.example/0", PAGE.format(0), "x", "y")]
    found = html_template.extract(spark.createDataFrame(rows, schema)).collect()
    texts = collections.Counter((r["page_id"], r["text"]) for r in found)
    assert texts[3, "Title 3 One & twobold text. Next line Last 3 para"] == 1 and texts[0, "Title 0 One & twobold text. Next line Last 0 para"] == 2
    assert texts[9, ""] == texts[10, ""] == texts[None, "Plain text More"] == 1
    assert html_template.extract(spark.createDataFrame([], schema)).count() == 0


def test_all_names_of_an_element_decide():
    long = " ".join(f"utility-{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    page = f'<body><p>Out</p><div class="{long}" role="main"><p>Body</p><div class="{long}" id="comments">First!</div></div></body>'
    assert html_template.main_text(page, frozenset()) == "Body"
    assert len({html_page.element_key("div", f' class="{long}" id="{i}"') for i in ("a", "b")}) == 2


@pytest.mark.parametrize("outer", ["layout has-sidebar", "no-sidebar", "page-with-header", "sticky-header", "sidebar", "site header"])
@pytest.mark.parametrize("inner", ["category-legal", "tag-social", "search-results"])
def test_articles_are_not_dropped(outer, inner):
    page = (f'<body><div class="{outer}"><article class="{inner}"><p>Body</p><div class="comment-list">First!</div></article></div>'
            '<div id="cookie-notice">We</div><div class="sidebar"><article>Teaser</article></div><p class="site-footer">Foot</p></body>')
    assert html_template.main_text(page, frozenset()) == ("Body" if outer not in ("sidebar", "site header") else "Body Teaser")
    assert html_template.main_text(f'<body><div class="{outer}"><article>Body</article></div></body>', frozenset()) == "Body"
    assert html_template.main_text('<body><div class="has-sidebar"><p>Body</p></div></body>', frozenset()) == "Body"


def test_articles_of_broken_and_varied_pages(spark):
    """One page leaves its article open, names differ from page to page, one article is of a rare layout."""
    page = ('<html><body><nav>Menu</nav><div>Before</div><article class="post category-{0} tag-{0}"><header><h1>Title {0}</h1></header>'
            '<p>Body {0}</p></article><div>After</div></body></html>')
    names = "abcdefgh"
    rows = [(i, f"https://a.example/{i}", page.format(c)) for i, c in enumerate(names)]
    rows += [(20, "https://a.example/20", page.format("x").replace("</article>", ""))]
    rows += [(21, "https://a.example/21", page.format("z").replace("article", "main").replace('class="post ', 'class="rare '))]
    many = "".join(f'<i class="{chr(97 + i % 26)}{chr(97 + i // 26)}"></i>' for i in range(600))
    rows += [(i, f"https://b.example/{i}", page.format(c).replace("<nav>", f"{many}<nav>")) for i, c in enumerate(names, 30)]
    schema = "page_id long, url string, html string"
    found = {r["page_id"]: r["text"] for r in html_template.extract(spark.createDataFrame(rows, schema)).collect()}
    assert [found[i] for i in range(8)] == [found[i] for i in range(30, 38)] == [f"Title {c} Body {c}" for c in names]
    assert found[21] == "Title z Body z"
    templates = {r["host"]: set(r["template"]) for r in html_template.deduce(spark.createDataFrame(
        [("a.example", u, h) for _, u, h in rows if "a.example" in u], "host string, url string, html string")).collect()}
    post, = html_template.name_tokens("article class=post")
    assert post in templates["a.example"] and not html_template.name_tokens("article class=category-a") <= templates["a.example"]


def test_texts_of_the_template_go(spark):
    """Boilerplate without telling names goes; what only some pages share, or what is all of a page, stays."""
    page = ('<body><div class="x3f">A tagline</div><div class="k{0}"><h1>Title {1}</h1><p>Body {1}</p>{2}</div>'
            '<div class="q">Read more</div><div class="q">Read more</div></body>')
    rows = [(i, f"https://a.example/{i}", page.format(i, c, "<p>Quoted</p>" if i < 5 else "")) for i, c in enumerate("abcdefgh")]
    rows += [(i, f"https://b.example/{i}", "<body><div><p>The same</p></div></body>") for i in range(20, 25)]
    rows += [(i, f"https://c.example/{i}", "<body><main><p>Two {0}</p><p>alike</p></main></body>".format(i)) for i in (30, 31)]
    schema = "page_id long, url string, html string"
    found = {r["page_id"]: r["text"] for r in html_template.extract(spark.createDataFrame(rows, schema)).collect()}
    assert [found[i] for i in range(8)] == [f"Title {c} Body {c}" + " Quoted" * (i < 5) for i, c in enumerate("abcdefgh")]
    assert {found[i] for i in range(20, 25)} == {"The same"}
    assert found[30] == "Two 30 alike"


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_dup", "decontaminate", "bpe_encode"]
    docs = table(spark, SF, "documents")
    left = corpus_pipeline.drop_low_quality(spark, docs, SF)
    rows = [tuple(r) for r in left.select("doc_id", "text").collect()]
    unique = corpus_pipeline.drop_near_duplicates(spark, left, SF)
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted({c for _, _, c in brute_components(rows, 5, 80)})
    assert unique.columns == docs.columns


def test_pipeline_run(spark):
    found = corpus_pipeline.run(spark, SF)
    assert set(found.columns) == {"doc_id", "text", "lang", "source", "n_chars", "token_ids"}
    rows = found.collect()
    assert rows and all(len(r["token_ids"]) > 0 for r in rows)


def test_pipeline_takes_edge_cases(spark, edge):
    docs = edge
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert set(docs.columns) == set(edge.columns)
    assert {r["doc_id"] for r in docs.collect()} <= {6}


@pytest.mark.parametrize("bit", ["<a t=\"'", "<!", "<script \"", "<a '", "<![", "<p class='x\">"])
def test_broken_pages_are_read_in_linear_time(bit):
    """A megabyte of tags that never end: no part is read again and again, and no character is lost."""
    page = "<article><p>Body.</p></article>" + bit * (1_000_000 // len(bit))
    start = time.perf_counter()
    parts = list(html_page.tokens(page))
    html_page.elements(parts)
    assert time.perf_counter() - start < 20
    assert parts[:5] == list(html_page.tokens("<article><p>Body.</p></article>"))


def test_broken_tokens_equal_the_pattern():
    """The linear form finds the tokens that the pattern finds place by place."""
    rng = random.Random(4)
    bits = ['<a t="', '"', "'", ">", "<", "text ", "<!", "<!-- x", "-->", "<script>", "</script>", '<p class="x">', "</p>", " b=", "<?", "/"]
    for _ in range(3000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        plain = [t for m in html_page._TOKEN.finditer(page) for t in html_page._token(m)]
        assert list(html_page.tokens(page)) == plain


def test_a_page_of_many_open_elements(spark):
    page = "<article>" + "<a>" * 50_000 + "</b>" * 50_000 + "text</article>"
    rows = spark.createDataFrame([(1, "http://h/1", page), (2, None, '<p t="' * 30_000)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_template.extract(rows).collect()}[1] == "text"
