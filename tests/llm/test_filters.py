"""Quality rules, toxicity, language identification and decontamination."""

import base64
import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from centflow.llm import decontaminate, language_id, quality_rules, queries, toxicity
from centflow.llm.batches import table
from centflow.llm.clause_grammar import CLASSES, MARKS, Grammar, machines

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words, seen, duplicates = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    times = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if times[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(covered)


def test_quality_counts_equal_brute_force(spark):
    random.seed(1)
    texts = ["", None, " ", "\n\n", "a b c a b c", "a\n a\na\n\n \n", "x|<y>\x0b\x1c z"]
    texts += ["".join(random.choices(["a", "b", " ", "\n", "é", "\x85", "  "], k=60)) for _ in range(500)]
    texts += [r["text"] for r in table(spark, SF, "documents").collect()]
    found = quality_rules.measures(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        n, _, _, _, repeated = expected = counts(text)
        assert tuple(int(found[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected
        assert bool(found["base_failed"][i]) == (n < 50 or 100 * repeated > 50 * n)
        assert not (found["base_failed"][i] and found["kept"][i])


def test_large_vocabulary_of_windows():
    codes, doc = np.array([0, 1, 2, 0, 1, 2, 3]), np.zeros(7, int)
    small, large = (quality_rules._repeated(doc, codes, n) for n in (4, 1 << 22))
    assert small.tolist() == large.tolist() == [True] * 6 + [False]


def test_compression_bands():
    random.seed(2)
    prose = " ".join("".join(random.choices("etaoinshrdlu", k=random.randint(2, 8))) for _ in range(3000))
    prose = " ".join(random.choices(prose.split()[:800], k=3000))
    noise = "".join(random.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=9000))
    noise = " ".join(noise[i:i + 60] for i in range(0, 9000, 60))
    same = " ".join(f"buy now item {i % 7}" for i in range(2000))
    kept = quality_rules.measures(pa.array([prose, noise, same]))["kept"]
    assert kept.tolist() == [True, False, False]


def test_every_chunk_is_checked():
    """Repeats and encoded files within a text of any length, and prose that stays."""
    random.seed(6)
    known = ["".join(random.choices("etaoinshrdlu", k=random.randint(2, 8))) for _ in range(800)]
    prose = lambda size: " ".join(random.choices(known, k=size))[:size]
    encoded = lambda size: base64.encodebytes(random.randbytes(size)).decode()[:size]
    same = ("buy this very cheap new item now " * 200)[:3400]
    texts = [same + prose(4700), prose(4700) + same, prose(60_000) + encoded(40_000), encoded(7000),
             prose(8100), prose(5000), prose(4097), prose(100_000), prose(3000)]
    found = quality_rules.measures(pa.array(texts))
    assert not found["base_failed"].any()
    assert found["kept"].tolist() == [False] * 4 + [True] * 5


def test_quality_edge_cases(edge, frame):
    found = quality_rules.measure(edge)
    assert found.count() == edge.count() and found.where("kept is null or n_words is null").count() == 0
    assert set(quality_rules.keep(edge).columns) == set(edge.columns)
    assert quality_rules.measure(frame([])).count() == 0


def test_grammar_frames():
    grammar = Grammar({"idiot": 5.0})
    cases = {"an idiot here": ("insult", False, "plain"), "you are an idiot": ("insult", True, "plain"),
             "he is not an idiot": ("insult", True, "negated"), "people said idiot": ("insult", False, "reported"),
             "kill the plan": ("threat", False, "plain"), "you said. an idiot": ("insult", False, "plain"),
             "not one two three four idiots": ("insult", False, "plain")}
    for text, expected in cases.items():
        found = grammar.features(text)
        assert [c for c, v in zip(CLASSES, found) if v] == [expected], text
    assert not any(grammar.features("skill and videos"))


def test_clauses_are_read_to_their_ends():
    """However far target, negation or report are from the insult."""
    grammar = Grammar({"idiot": 1.0})
    for gap in (0, 100, 5_000):
        far = "word " * gap
        for text, cls in ((f"{far}idiot", ("insult", False, "plain")), (f"you {far}idiot", ("insult", True, "plain")),
                          (f"idiot {far}you", ("insult", True, "plain")), (f"she wrote {far}idiot", ("insult", True, "reported")),
                          (f"idiot {far}reported", ("insult", False, "reported")), (f"you. {far}idiot", ("insult", False, "plain"))):
            found = grammar.features(text)
            assert [c for c, v in zip(CLASSES, found) if v] == [cls]


def _tapes(machine, tape, weight):
    """All (written tape, weight) of a machine that reads a tape of (mark, weight of the word)."""
    paths = [(machine.start, [], weight)]
    for mark, w in tape:
        paths = [(to, [*written, (mark2, w)], v * w if takes else v) for state, written, v in paths
                 for mark2, takes, to in machine.arcs[state].get(mark, ())]
    return [(written + [(m, 1.0) for m in machine.ends[state]], v) for state, written, v in paths if state in machine.ends]


def test_composed_grammar_equals_its_transducers_one_after_the_other():
    stems = {"idio": 4.0, "moro": 2.5}
    words = {"insult": ["idiots", "moron"], "threat": ["kill"], "target": ["you"], "negation": ["not"], "report": ["said"], "word": ["it", "so"]}
    assert set(words) == set(MARKS)
    grammar, draw, seen = Grammar(stems), random.Random(5), set()
    for _ in range(400):
        clause = [draw.choice(words[draw.choice(MARKS)]) for _ in range(draw.randrange(10))]
        tapes = [([grammar.mark(w) for w in clause], 1.0)]
        for machine in machines():
            tapes = [(t, v) for tape, weight in tapes for t, v in _tapes(machine, tape, weight)]
        want = dict.fromkeys(CLASSES, 0.0)
        for tape, weight in tapes:
            for mark, _ in tape[len(clause):]:
                if mark in want:
                    want[mark] += weight
        found = dict(zip(CLASSES, map(math.expm1, grammar.features(" ".join(clause)))))
        assert found == pytest.approx(want)
        seen |= {c for c in want if want[c]}
    assert seen == set(CLASSES)


def test_toxicity_held_out(spark):
    found = queries.op3_toxicity(spark, LARGER).join(table(spark, LARGER, "labels"), "doc_id").where("held_out").collect()
    hits = sum(r["toxic"] == r["predicted"] for r in found)
    toxic = [r for r in found if r["toxic"]]
    assert hits / len(found) > 0.95 and sum(r["predicted"] for r in toxic) / len(toxic) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)


def test_toxicity_edge_cases(spark, edge, frame):
    labels = spark.createDataFrame([(4, 1), (6, 0), (6, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(edge, labels)
    found = toxicity.predict(edge, model)
    assert found.count() == edge.count() and found.where("score is null").count() == 0
    assert set(toxicity.keep(edge, model).columns) == set(edge.columns)
    none = toxicity.fit(frame([]), labels.limit(0))
    assert none.stems == {} and toxicity.predict(frame([]), none).count() == 0


def test_language_held_out(spark):
    found = queries.op10_language_id(spark, LARGER).where("held_out").join(
        table(spark, LARGER, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.99
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_kernel_is_by_presence():
    a = language_id.presence(pa.array(["The cat!", "  the   CAT  ", "the", None]))
    assert (a[0] == a[1]).all() and language_id.kernel(a, a)[0, 1] == pytest.approx(1) and a[2].sum() < a[0].sum()


def test_language_edge_cases(edge, frame):
    model = language_id.fit(edge.withColumn("lang", edge["source"]))
    found = {r["doc_id"]: r for r in language_id.predict(edge, model).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and found[4]["lang_pred"] == "src"
    assert language_id.predict(edge, model).count() == edge.count()
    none = language_id.fit(frame([]))
    assert {r["lang_pred"] for r in language_id.predict(edge, none).collect()} == {"und"}


def test_items_with_edits_are_found(spark):
    random.seed(0)
    items = [(r["item_id"], r["text"]) for r in table(spark, LARGER, "benchmark").collect()]
    index = decontaminate.Index(items)
    texts = [decontaminate.normalized(r["text"]) for r in table(spark, SF, "documents").collect()]
    for _ in range(200):
        j = random.randrange(len(items))
        passage = list(index.texts[j])
        for _ in range(int(index.edits[j])):
            p = random.choice([i for i, c in enumerate(passage) if c != " "])
            passage[p] = random.choice(["q", passage[p] + "z"])
        text = random.choice(texts)
        p = random.randrange(len(text) + 1)
        assert j in [m[1] for m in index.matches([decontaminate.normalized(text[:p] + "".join(passage) + text[p:])])]


def test_exact_items_equal_brute_force(spark):
    docs, items = table(spark, LARGER, "documents"), table(spark, LARGER, "benchmark").collect()
    texts = {r["doc_id"]: decontaminate.normalized(r["text"]) for r in docs.select("doc_id", "text").collect()}
    exact = {(i, r["item_id"]) for i, t in texts.items() for r in items if decontaminate.normalized(r["text"]) in t}
    found = queries.op8_decontaminate(spark, LARGER).collect()
    assert exact == {(r["doc_id"], r["item_id"]) for r in found if r["edits"] == 0}
    for r in found:
        assert r["stop"] - r["start"] <= 1.2 * max(len(decontaminate.normalized(x["text"])) for x in items if x["item_id"] == r["item_id"])


def test_blocks_of_items(monkeypatch, spark):
    whole = sorted(queries.op8_decontaminate(spark, "/root/testdata/sf0.01").collect())
    monkeypatch.setattr(decontaminate, "ITEMS", 7)
    assert sorted(queries.op8_decontaminate(spark, "/root/testdata/sf0.01").collect()) == whole


def test_decontamination_edge_cases(spark, edge, frame):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "abc"), (None, "word5 tail5. word6 tail6. word7 tail7.")], "item_id long, text string")
    found = decontaminate.find(edge, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(6, None), (7, None)}
    assert decontaminate.keep(edge, items).count() == edge.count() - 2
    assert decontaminate.find(edge, items.limit(0)).count() == 0 and decontaminate.find(frame([]), items).count() == 0
