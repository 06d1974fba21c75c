"""Trained operators: held-out accuracy, exact parts, odd rows."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainsift.llm import extraction, gru, hpy, langid, pages, toxicity
from grainsift.llm.queries import QUERIES
from grainsift.llm.tokens import LETTERS, joined, word_slices

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    got = QUERIES["op7_language"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_language_of_odd_rows(spark, edge_docs):
    model = langid.fit(spark.createDataFrame([("the cat and the dog and the end", "en"), ("der Hund und die Katze und der Baum", "de"),
                                              ("der Hund und der Rest", "de"), (None, "fr"), ("x", None)], "text string, lang string"))
    assert model.languages == ["de", "en"]
    got = langid.predict_language(edge_docs, model)
    rows = got.collect()
    assert len(rows) == 12
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        if not letters:
            assert r["score"] == 0
    assert langid.predict_language(edge_docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.predict_language(edge_docs, None).collect()} == {"und"}
    assert langid.fit(edge_docs.limit(0)) is None


def test_ngrams_stay_inside_words():
    hashes, word = langid.gram_hashes(["ab", "é", "漢字x"], 3)
    assert Counter(word.tolist()) == {0: 2, 1: 1, 2: 3}           # ␣ab ab␣ · ␣é␣ · ␣漢字 漢字x 字x␣
    same, _ = langid.gram_hashes(["ab"], 3)
    assert (hashes[:2] == same).all()
    assert Counter(langid.gram_hashes(["ab", "c"], 1)[1].tolist()) == {0: 2, 1: 1}


def test_unseen_words_fall_back_to_known_ngrams(spark):
    rows = [("schreibung beschreibung leitung zeitung", "de"), ("writing reading sleeping running", "en")] * 3
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    docs = spark.createDataFrame([("verleitung",), ("swimming",), ("ΩΩΩ",)], "text string")
    assert [r["lang_pred"] for r in langid.predict_language(docs, model).collect()][:2] == ["de", "en"]


def _numeric(weights, args, name, at, eps=1e-4):
    out = []
    for sign in (1, -1):
        weights[name][at] += sign * eps
        out.append(gru.gradient(weights, *args)[0])
        weights[name][at] -= sign * eps
    return (out[0] - out[1]) / (2 * eps)


def test_network_gradient(monkeypatch):
    rng = np.random.default_rng(0)
    weights = {k: v.astype(np.float64) for k, v in gru.initial(rng.normal(size=5), rng.normal(size=7), 1).items()}
    plain = gru.word_vectors
    class Wide(np.ndarray):
        pass
    monkeypatch.setattr(gru, "word_vectors", lambda w, word, gram, owner, scale: np.concatenate(
        [w["words"][word], np.stack([np.bincount(owner, weights=w["grams"][gram, d], minlength=len(word))
                                     for d in range(gru.CHAR_DIM)], axis=1) * scale[:, None]], axis=1))
    rows, here = rng.integers(0, 5, (6, 4)), np.ones((6, 4), bool)
    here[4:, 1] = False
    args = (np.array([0, 1, 5, 3, 4]), np.array([0, 1, 2, 3, 6, 5]), np.array([0, 0, 1, 2, 3, 4]), np.array([.5, .6, 1, 1, .7]),
            rows, here, np.array([1, 0, 1, 0.]), np.array([1, 2, 1, 1.]))
    _, grad = gru.gradient(weights, *args)
    for name, value in weights.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in value.shape)
            if name in ("words", "grams") and at[0] == len(value) - 1:
                assert grad[name][at] == 0
            else:
                assert grad[name][at] == pytest.approx(_numeric(weights, args, name, at), abs=2e-4)
    assert plain is not gru.word_vectors


def _toxic_texts(n, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("ne", "so", "da", "fi", "gu", "pa")]
    bad = ["vilestuff", "grimword", "nastything"]
    rows = []
    for i in range(n):
        text = [rng.choice(words) + rng.choice(words) for _ in range(rng.randrange(20, 300))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                text.insert(rng.randrange(len(text)), rng.choice(bad) + rng.choice(["", "s", "er"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_toxic_texts_are_told_from_clean_ones(spark):
    model = toxicity.fit(spark.createDataFrame(_toxic_texts(500, 1), "doc_id long, text string, toxic int"))
    rows = toxicity.score_toxicity(spark.createDataFrame(_toxic_texts(300, 2), "doc_id long, text string, toxic int"), model).collect()
    assert sum(r["toxic"] == r["predicted"] for r in rows) >= 0.97 * len(rows)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_toxicity_of_held_out_documents(spark):
    got = QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["predicted"] for r in rows if r["toxic"] == 0) <= 0.02 * (len(rows) - len(toxic))


def test_toxicity_of_odd_rows(spark, edge_docs):
    model = toxicity.fit(spark.createDataFrame(_toxic_texts(60, 3), "doc_id long, text string, toxic int"))
    rows = toxicity.score_toxicity(edge_docs, model).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert toxicity.score_toxicity(edge_docs.limit(0), model).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(edge_docs, None).collect()} == {0.0}
    assert toxicity.drop_toxic(edge_docs, model).columns == edge_docs.columns
    assert toxicity.fit(spark.createDataFrame([("a", 1), (None, 0), ("b", None)], "text string, toxic int")) is None
    labels = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (None, 1), (2, 0), (77, 1)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(edge_docs, labels)
    assert sorted((r["toxic"], r["text"][:4]) for r in sample.collect()) == [(0, "same"), (1, "The "), (1, "The ")]


def test_sample_of_labelled_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "EVIDENCE_DOCS", {1: 5, 0: 4})
    monkeypatch.setattr(toxicity, "TRAIN_CHARS", 40)
    docs = spark.createDataFrame([(i, f"text {i} " + "x " * (100 if i % 2 else 3)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, toxic int")
    def sample(labels):
        return [(r["toxic"], r["text"]) for r in toxicity.labelled_sample(docs, labels).collect()]
    got = sample(labels)
    assert Counter(t for t, _ in got) == {1: 5, 0: 4} and all(len(text) <= 40 for _, text in got)
    # long texts only where short ones run out, and then a stretch of them
    longs = sample(labels.filter("doc_id % 2 = 1"))
    assert Counter(t for t, _ in longs) == {1: 5, 0: 4} and {len(text) for _, text in longs} == {40}
    odd = sample(spark.createDataFrame([(2, 1), (2, 0), (4, 1), (4, 1), (6, 0), (99, 0), (None, 1), (8, 7)], "doc_id long, toxic int"))
    assert Counter((t, text.split()[1]) for t, text in odd) == {(1, "4"): 2, (0, "6"): 1}


def test_table_of_texts_is_that_of_their_words_together(monkeypatch):
    monkeypatch.setattr(toxicity, "COPIED_ROWS", 7)
    texts = pd.Series([text for _, text, _ in _toxic_texts(40, 4)] + ["", "one", "ÄÖ ü İK ß x", " \t "])
    part = joined(list(word_slices(pa.array(texts, pa.string()), LETTERS)))
    words, grams = np.unique(part.hash)[::3], np.unique(toxicity.gram_hashes([part.text(i) for i in range(50)], 4)[0])
    for column, whole in ((texts, part), (texts[-1:], next(word_slices(pa.array(["-"]), LETTERS)))):
        rows, first = toxicity.Lookup(words, grams).table(column)
        assert first.tolist() == whole.first.tolist()
        for got, want in zip(rows, toxicity.Lookup(words, grams).rows(whole), strict=True):
            assert got.tolist() == want.tolist()


def test_fitting_holds_little_on_the_driver(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", (1, 1))
    rows = spark.createDataFrame([(" ".join([text] * 8), toxic) for _, text, toxic in _toxic_texts(400, 5)], "text string, toxic int")
    size = rows.agg(F.sum(F.length("text"))).first()[0]
    list(word_slices(pa.array(["a table made once"])))
    tracemalloc.start()
    try:
        toxicity.fit(rows)
        assert tracemalloc.get_traced_memory()[1] < 9 * size
    finally:
        tracemalloc.stop()


def test_copies_do_not_fill_the_language_sample(spark):
    rows = [(i, "das ist ein und derselbe Text", "de") for i in range(200)] + [
        (200 + i, f"ein anderer Satz mit Wort{chr(97 + i % 26)}{chr(97 + i // 26)}", "de") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, train_docs=100)
    assert len(model.words) >= 9                 # words of both kinds of text, seen more than once


def test_windows_cover_every_word():
    first = np.array([0, 0, 3, 51, 150, 1000])
    start, end, row = toxicity.windows(first)
    assert 0 not in row
    for r in range(1, 5):
        mine = [(s, e) for s, e, x in zip(start, end, row) if x == r]
        assert mine[0][0] == first[r] and mine[-1][1] == first[r + 1]
        assert all(e - s <= toxicity.WINDOW for s, e in mine)
        assert all(b[0] - a[0] == toxicity.STRIDE for a, b in zip(mine, mine[1:]))


PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var a="</p><article>no</article>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a><li><a href="/b">About us</a></ul></nav>
<div class="cookie-notice">We use cookies to improve this site. <button>OK</button></div><!-- <p>hidden</p> -->
<article><h1>The  title &amp; more</h1><p>First paragraph with <b>bold <i>words</b></i> and a
line break, all in one.<p>Second paragraph &lt;here&gt; with an &eacute; and&nbsp;a space.<br>After the break it goes on, to the end.
<div class="ad">Buy things now</div><p>Third paragraph, which is long enough to be read as text by anyone.</article>
<section id="comments"><h3>Comments</h3><p>I liked the first paragraph, thanks for writing it, friend.</p></section>
<aside><h4>Related</h4><a href="/x">Another page to read</a></aside>
<form><label>Name</label><input><textarea>typed text</textarea></form><footer>&copy; 2024 Example</footer></body></html>"""


@pytest.fixture(scope="module")
def chain(spark):
    return extraction.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_main_text_of_a_page(chain):
    assert extraction.main_text(chain, PAGE).split("\n") == [
        "The title & more", "First paragraph with bold words and a line break, all in one.",
        "Second paragraph <here> with an é and a space. After the break it goes on, to the end.",
        "Third paragraph, which is long enough to be read as text by anyone."]


def test_held_out_layouts(spark, chain):
    html = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").orderBy(F.desc("page_id")).limit(60).collect()]
    right = total = 0
    for rows, labels in extraction.examples_from(html, seed=99):
        got = extraction.decode(chain, rows)
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right >= 0.98 * total


def test_articles_of_the_given_pages(spark):
    got = QUERIES["op9_extraction"](spark, SF).collect()
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(html)
    right = 0
    for r in got:
        assert r["n_chars"] == len(r["text"])
        right += r["text"] == "\n".join(b.text for b in pages.blocks(html[r["page_id"]]) if "article" in b.path)
    assert right >= 0.99 * len(got)


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(1, 7))
        chain = extraction.Chain({f"f{i}": tuple(rng.normal(size=2)) for i in range(n)}, rng.normal(size=(2, 2)), rng.normal(size=2))
        rows = [[f"f{i}", "unknown"] for i in range(n)]
        def value(path):
            total = chain.first[path[0]] + sum(chain.features[f"f{i}"][l] for i, l in enumerate(path))
            return total + sum(chain.step[a, b] for a, b in zip(path, path[1:]))
        paths = [[(k >> i) & 1 for i in range(n)] for k in range(2 ** n)]
        assert value(extraction.decode(chain, rows)) == pytest.approx(max(map(value, paths)))


def test_odd_pages(spark, chain):
    odd = [None, "", "   ", "plain text only", "<p>unclosed <b>tags", "<article><p>cut off in a ta", "<article><p>text <a hre", "<!-- never ends <p>x",
           "<script>never ends", "</p></div>stray", "<p>1 < 2 & 3 > 2</p>", "<article>" + "<p>long words here and there, again.</p>" * 5000 + "</article>",
           "<" * 200, "<div " * 300, '<a title="' * 200, "&am &amp &#x41; &#0;"]
    df = spark.createDataFrame([(i, None, h, "mine") for i, h in enumerate(odd)] + [(None, "u", "<p>x", None)],
                               "page_id long, url string, html string, text string")
    got = extraction.extract_main_text(df, chain).collect()
    assert len(got) == len(odd) + 1 and all(r["n_chars"] == len(r["text"]) for r in got)
    by_id = {r["page_id"]: r["text"] for r in got}
    assert by_id[0] == by_id[1] == by_id[2] == by_id[7] == by_id[8] == ""
    assert len(by_id[11].split("\n")) == 5000
    assert extraction.extract_main_text(df.limit(0), chain).count() == 0
    assert [b.text for b in pages.blocks("<p>1 < 2 & 3 > 2</p>")] == ["1 < 2 & 3 > 2"]


@pytest.mark.parametrize("page, texts", [
    ("<article><p>Before.</p><p>Let <math/> be given.</p><p>More.</p></article>", ["Before.", "Let be given.", "More."]),
    ('<p>One</p><svg class="x"/><p>Two</p>', ["One", "Two"]),
    ('<p>One <svg viewBox="0 0 1 1"><path d="M0"/><text>no</text></svg> end</p><p>Two</p>', ["One end", "Two"]),
    ("<form><select><option>a<option>b</form><p>After</p>", ["After"]),
    ("<div><div><svg><g></div><p>In</p></div><p>Out</p>", ["In", "Out"]),
    ("<div><svg><foreignObject><div>no</div></foreignObject></svg><p>In</p></div>", ["In"]),
    ("<p>One</p><svg><p>Two</p>", ["One", "Two"]),
    ("<p title=it's>One</p><p>It's two</p><p>Three</p>", ["One", "It's two", "Three"]),
    ("<p title = 'a > b' id=\"c > d\">One</p><p data-x='>'>Two</p>", ["One", "Two"]),
    ("<p>One <script>if (a < b) '</p>'</script>more</p>", ["One more"]),
    ("<p \"odd' quotes>One</p>", ["One"]),
])
def test_markup_that_is_no_text_takes_none_with_it(page, texts):
    assert [b.text for b in pages.blocks(page)] == texts


@pytest.mark.parametrize("keys", [[], [5], [5, 5, 5], [2**48 - 1, 0, 7, 0, 7, 0, 2**40, 2**64 - 1]])
def test_repeated_keys_are_a_round_trip(keys):
    keys = np.array(keys, np.uint64)
    assert np.array_equal(hpy.unpack_repeated(hpy.pack_repeated(keys)), keys)


def test_packing_is_a_round_trip():
    rng = np.random.default_rng(2)
    for values in (np.zeros(0, np.int64), np.arange(300), rng.integers(0, 1 << 40, 1000), rng.normal(size=50)):
        assert (hpy.unpack(hpy.pack(values)) == values).all()
    keys = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))
    assert (hpy.unpack_sorted(hpy.pack_sorted(keys)) == keys).all()


@pytest.mark.parametrize("c,others,base", [(2, 3, 0.2), (10, 50, 0.05), (40, 5, 0.3), (200, 40, 0.1), (100, 900, 0.2), (60, 3, 0.001), (300, 400, 0.05)])
def test_tables_follow_the_seating_of_customers(c, others, base):
    """Against weights of whole seatings, found by filtering forward over customers."""
    d, s, n = 0.6, 1.5, 4000
    got = hpy.draw_tables(np.full(n, c), np.full(n, others), np.full(n, base), d, s, np.random.default_rng(1))
    weight = {1: (s + d * others) * base}
    for k in range(1, c):
        after = Counter()
        for t, w in weight.items():
            after[t] += w * (k - d * t)
            after[t + 1] += w * (s + d * (others + t)) * base
        top = max(after.values())
        weight = {t: w / top for t, w in after.items()}
    total = sum(weight.values())
    mean = sum(t * w for t, w in weight.items()) / total
    assert got.min() >= 1 and got.max() <= c
    assert abs(got.mean() - mean) < (0.03 if c <= hpy.EXACT_CUSTOMERS else 0.1) * mean


def _tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def _check_model(rows, train):
    counts = Counter(w for t in train for w in _tokens(t))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        words = _tokens(r["text"])
        assert r["n_tokens"] == len(words) and r["n_known"] == sum(counts[w] > 0 for w in words) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert r["score"] < 0


def test_model_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = QUERIES["op2_hpy_lm"](spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in rows)
    _check_model(rows, [r["text"] for r in rows if not r["held_out"]])
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)


def test_predictions_sum_to_one(spark):
    """P(first word) over all words: a text "w x" against its rest, "x" after w, which other texts give."""
    train = ["a b c a b d", "a b a c", "b b b a d"] * 4
    words = ["a", "b", "c", "d", "zz"]
    rows = [(None, t, False) for t in train] + [(w, w, True) for w in words] + [(f"{w} {w}", f"{w} {w}", True) for w in words] + [
        (f"{w} {w} {w}", f"{w} {w} {w}", True) for w in words] + [("", "", True)]
    got = {r["doc_id"]: r["score"] for r in hpy.fit_and_score(
        spark.createDataFrame(rows, "doc_id string, text string, held boolean"), F.col("held")).collect()}
    def after_itself(w):
        return 10 ** (got[f"{w} {w} {w}"] - got[f"{w} {w}"])
    def ends_after(w):
        return 10 ** (got[f"{w} {w}"] - got[w]) / after_itself(w)
    # log P(w) = log P(w | start) + log P(end | w), and log P(w w) = log P(w) + log P(w | w)
    assert all(got[f"{w} {w}"] == pytest.approx(got[w] + math.log10(after_itself(w))) for w in words)
    assert all(0 < after_itself(w) < 1 and ends_after(w) == pytest.approx(1) for w in words)


def test_model_of_odd_rows(spark, edge_docs):
    rows = hpy.fit_and_score(edge_docs, F.coalesce(F.col("doc_id"), F.lit(0)) == 6).collect()
    assert len(rows) == 12 and sum(r["held_out"] for r in rows) == 2
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert by_id[2]["n_tokens"] == by_id[3]["n_tokens"] == by_id[7]["n_tokens"] == 1
    assert by_id[5]["score"] == pytest.approx(by_id[6]["score"]) and by_id[4]["n_tokens"] == 60_003
    assert hpy.fit_and_score(edge_docs.limit(0), F.lit(False)).count() == 0
    none = hpy.fit_and_score(edge_docs, F.lit(True)).collect()
    assert len(none) == 12 and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in none)


def test_every_previous_word_has_its_own_restaurant(spark):
    """Each of many words is always followed by one word of its own, which no shared restaurant could know."""
    n = 40_000
    rows = [(str(i), f"first{i} then{i} first{i} then{i}", False) for i in range(n)]
    rows += [("own", "first7 then7", True), ("other", "first7 then8", True)]
    got = {r["doc_id"]: r["score"] for r in hpy.fit_and_score(
        spark.createDataFrame(rows, "doc_id string, text string, held boolean").repartition(2), F.col("held")).collect()}
    assert len(got) == n + 2 and got["own"] - got["other"] > 4
    words = np.array([zlib.crc32(str(i).encode()) for i in range(n)], np.uint64)
    assert len(np.unique(hpy.mix(words) >> np.uint64(64 - hpy.CONTEXT_BITS))) == n
