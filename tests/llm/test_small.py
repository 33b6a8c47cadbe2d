"""Each operator on small planted tables: exact answers, and nulls, empty texts, ties, repeats, clashing columns."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quoin.llm import chat, decontaminate, htmltext, jaccard, langid, mixing, ngramlm, quality, queries, sampling, topk, toxicity
from quoin.llm.common import arrow_bloom, arrow_bytes, components, id_bloom, map_arrow, without_ids

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, h long, node long, _maybe boolean"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def docs_of(spark, rows):
    """Rows (doc_id, text, lang, source) with further columns of names that operators use themselves."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, 2, True) for r in rows], DOCS)


@pytest.fixture(scope="module")
def some(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").limit(120).collect()]
    rows += [(900, None, None, None), (901, "", "en", "src1"), (902, " \t\n", "en", None), (903, rows[0][1], "en", "src0"), (903, rows[0][1], "en", "src0"), (None, "no id at all here", "en", "src2"), (904, "123 456 !!", "en", "src3"), (905, "word " * 60_000, "en", "src4"), (906, "é", None, "src5")]
    return rows


# -- shared parts --------------------------------------------------------------------------------------
def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (101, 102), (7, 7)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert all(got[i] == 1 for i in range(1, 41)) and {got[i] for i in (100, 101, 102)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_without_ids(spark, some):
    docs = docs_of(spark, some)
    kept = without_ids(docs, spark.createDataFrame([(0,), (903,), (None,)], "doc_id long"))
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in some if r[0] not in (0, 903))
    maybe = id_bloom(spark.range(50))
    assert spark.range(50).where(maybe(F.col("id"))).count() == 50
    assert spark.range(10_000, 20_000).where(maybe(F.col("id"))).count() < 1000
    many = id_bloom(spark.range(0, 200_000, 1, 40))  # forty parts of one filter
    assert spark.range(200_000).where(many(F.col("id"))).count() == 200_000
    assert spark.range(1_000_000, 1_100_000).where(many(F.col("id"))).count() < 5000
    none = id_bloom(spark.createDataFrame([], "id long"))
    assert spark.range(10).where(none(F.col("id"))).count() == 0


# -- 1 mixing ------------------------------------------------------------------------------------------
def test_quotas_and_flow():
    assert mixing.quotas({"a": 10, "b": 100}, {"a": 3, "b": 1}, 80, 2) == {"a": 20.0, "b": 60.0}
    # the overlap serves b, which has nothing of its own, before anything is repeated
    got = mixing.route([(("a",), 10), (("a", "b"), 10)], {"a": 10, "b": 10}, 2)
    assert got[0] == {"a": 10} and got[1] == {"a": 0, "b": 10}
    assert sum(sum(x.values()) for x in mixing.route([(("a",), 10)], {"a": 100}, 2)) == 20


def test_mixing(spark, some):
    got = mixing.mix_documents(docs_of(spark, some)).collect()
    assert len(got) == len(some)
    sizes = Counter()
    for _, t, _, s in some:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.quotas({s: sizes[s] for s in order}, mixing.cycle_weights(order), 1.5 * sum(sizes.values()), 2)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source]) and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    largest = {s: max(len(WORD.findall(t or "")) for _, t, _, x in some if x == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(docs_of(spark, some).repartition(5)).collect()))
    assert mixing.mix_documents(docs_of(spark, [])).count() == 0


# -- 2 language ----------------------------------------------------------------------------------------
def test_ngram_counts_in_blocks(monkeypatch):
    texts = ["Ein Text", "", "another, longer text " * 20]
    want = langid.ngram_counts(texts)
    monkeypatch.setattr(langid, "_BLOCK", 7)
    assert (langid.ngram_counts(texts) == want).all() and want[2].sum() == 3 * (len(texts[2]) + 1)


def test_language(spark, some):
    docs = docs_of(spark, some)
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert len(got) == len(some)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (900, 901, 902, 904))
    truth = {d: lang for d, _, lang, _ in some}
    sure = [r for r in got if r.doc_id is not None and r.doc_id < 900]
    assert sum(r.lang_pred == truth[r.doc_id] for r in sure) > 0.9 * len(sure) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(docs.where("false"))).collect()} == {"und"}


def test_held_out_languages(spark):
    truth = dict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect())
    got = queries.QUERIES["op2_language"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got]) > 0.97


def test_known_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = {-1: "Ελληνικά γράμματα που κανείς δεν έμαθε εδώ ποτέ " * 5, -2: "12 34 !!", -3: None, -4: "кириллица здесь никому не известна совсем " * 5}
    planted = spark.createDataFrame([(k, v, None, None, None) for k, v in odd.items()], docs.schema)
    kept = {r.doc_id for r in langid.known_language(docs.unionByName(planted)).select("doc_id").collect()}
    assert not kept & set(odd) and len(kept) > 0.99 * docs.count()


# -- 3 toxicity ----------------------------------------------------------------------------------------
def test_toxicity(spark):
    r = np.random.default_rng(0)
    plain = [f"w{k}" for k in range(300)]
    rows, marks = [], []
    for d in range(400):
        words = list(r.choice(plain, 40))
        bad, low = d % 4 == 0, d % 5 == 0
        if bad:
            words[5:7] = [["vile", "foulness"][d % 8 // 4], "vile"] if d % 8 == 0 else ["foul" + str(d), "w1"]
        if low:
            words[20:] = ["junk"] * 20
        rows.append((d, " ".join(words), "en", "s"))
        marks.append((d, int(not low), int(bad)))
    rows += [(900, None, None, None), (901, "", None, None), (902, "VILE vile vile", None, None), (0, rows[0][1], None, None), (903, "w1 " * 200_000 + "vile foulness", None, None)]
    docs, labels = docs_of(spark, rows), spark.createDataFrame([*marks, (5, 1, None), (None, 1, 1), (7, None, 0), (901, 1, 0)], "doc_id long, quality int, toxic int")
    found = toxicity.classify(docs, toxicity.fit(docs, labels)).collect()
    got = {x.doc_id: x for x in found}
    assert len(found) == len(rows) and sum(got[d].toxic == (d % 4 == 0) for d in range(400)) >= 396
    assert sum((got[d].low_quality > 0.5) == (d % 5 == 0) for d in range(400)) >= 390
    assert got[902].toxic and got[903].toxic and not got[900].toxic and not got[901].toxic
    assert {x.doc_id for x in toxicity.not_toxic(docs, labels).collect()} == {d for d in got if not got[d].toxic}
    assert not toxicity.classify(docs, toxicity.fit(docs, labels.where("toxic = 0"))).where("toxic").count()
    assert not toxicity.classify(docs, toxicity.fit(docs.where("false"), labels)).where("toxic").count()
    assert toxicity.classify(docs.where("false"), toxicity.Chain()).count() == 0


def test_toxicity_of_texts_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    apart = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    got = toxicity.classify(docs.where(apart), toxicity.fit(docs, labels.where(~apart))).join(labels.withColumnRenamed("toxic", "truth"), "doc_id").collect()
    both = sum(x.toxic and x.truth for x in got)
    assert both > 0.85 * sum(x.truth for x in got) and both > 0.9 * sum(x.toxic for x in got)


def test_samples(spark):
    rows = [(None, f"t{i}", "a") for i in range(500)] + [(i % 2, "same", "b") for i in range(500)] + [(7, "x", None), (9, "only", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    for parts in (1, 7):
        got = Counter((r.label, r.share) for r in sampling.per_label(df.repartition(parts), "label", 100).collect())
        assert got == {("a", 0.2): 100, ("b", 0.2): 100, ("c", 1.0): 1}
    assert sampling.per_label(df.where("false"), "label", 5).count() == 0


# -- 4 top k -------------------------------------------------------------------------------------------
def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 7)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=4).round(2).tolist()) for i in range(60)] + [(60 + i, rows) for i, rows in enumerate([[1.0, 1.0, 1.0, 1.0]] * 20)]
    odd = [(200, None), (201, [1.0, None, 1.0, 1.0]), (202, [1.0, math.nan, 0.0, 0.0]), (203, [math.inf, 0.0, 0.0, 0.0]), (None, [1.0] * 4), (204, []), (205, [1.0, 2.0]), (1, rows[1][1])]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>").repartition(5)
    got = sorted(map(tuple, topk.top_k(df.where("id % 10 = 0"), df, 5).select("query_id", "rank", "vec_id", "score").collect()))
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in [*rows, odd[-1]]]
    want = []
    for q, v in dict(rows).items():
        if q % 10 == 0:
            v = [math.floor(256 * x) for x in v]
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.products(np.array([[2.0**40, 2.0**40]]), np.array([[2.0**40, -(2.0**40) + 1]]))[0, 0] == 2**40
    assert topk.top_k(df.where("false"), df).count() == 0


def test_topk_repeated_query(spark):
    import duckdb

    rows = [(0, [None, 9.0]), (0, [-math.inf, 9.0]), (0, [math.nan, 0.0]), (0, None), (0, []), (0, [1.0011, 2.0]), (0, [1.001, 3.0]), (50, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = df.selectExpr("vec_id AS id", "embedding AS v")
    got = topk.top_k(ask.where("id % 50 = 0"), ask, 5).select("query_id", "rank", "vec_id", "score").collect()
    db = duckdb.connect()
    db.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    db.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    want = db.execute(topk.OP4_SQL).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and {r[0] for r in want} == {0, 50}


# -- 5 chat --------------------------------------------------------------------------------------------
def test_escapes():
    for text in ("", "\\", "<|turn|>", "\\<|end|>\\", "</s>[INST] ok [/INST]", "<\\|turn|>", "<<SYS>>\\\\<</SYS>>", "\\\n<s>"):
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)


@pytest.mark.parametrize("vocabulary", [None, chat.VOCABULARY])
def test_chat(spark, vocabulary):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no é €"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 2, "user", None), (4, None, None, "x<|end|>"), (4, 2, "assistant", ""), (None, 1, "assistant", "n"), (5, 0, "user", "other"), (6, 0, "user", "hi"), (6, 1, "assistant", "yes")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packs = chat.format_chats(df.repartition(3), vocabulary, 10_000)
    got = {r.conv_id: r for r in chat.read_back(packs, vocabulary).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(t for _, role, t in turns if role == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(said)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    code = chat.codec(vocabulary)
    shared = [p for p in packs.collect() if any(c.conv_id == 1 for c in p.conversations)]
    text = code.decode([t for p in shared for t in p.tokens])
    assert text.count("hi") == len(shared)  # once a pack
    for p in packs.collect():
        for s in p.segments:
            spans = list(zip(s.attends[::2], s.attends[1::2]))
            assert spans[-1][1] == s.stop and p.position_ids[s.stop - 1] + 1 == sum(b - a for a, b in spans)
    small = chat.read_back(chat.format_chats(df, vocabulary, 1), vocabulary)
    assert sorted(map(str, small.collect())) == sorted(map(str, got.values()))
    assert chat.format_chats(df.where("false"), vocabulary).count() == 0


# -- 6 decontamination ---------------------------------------------------------------------------------
def test_edit_search():
    def plain(item, text):
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            new = [i]
            for j, b in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)

    r = np.random.default_rng(0)
    for _ in range(60):
        item, text = ("".join(r.choice(list("abc "), r.integers(1, n))) for n in (12, 40))
        assert decontaminate.edit_search(item, decontaminate.masks(item), text)[0] == plain(item, text)


def test_contaminated(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = dict(items.select("item_id", "text").collect())
    clean = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").collect()]
    clean = [t for t in clean if not any(decontaminate.normal(x) in decontaminate.normal(t) for x in texts.values())]
    r, rows, want = np.random.default_rng(1), [], set()
    for k, (i, x) in enumerate(texts.items()):
        host = clean[k % len(clean)]
        edits = "".join(c if r.random() > 0.05 else r.choice(list("xyz")) for c in x)
        rows += [(100 + k, f"{host} {x.upper()} {host}"), (300 + k, f"{host[:200]}\n{edits}\t{host}")]
        want |= {(100 + k, i), (300 + k, i)}
    rows += [(500 + k, t) for k, t in enumerate(clean)] + [(600, None), (601, ""), (None, next(iter(texts.values())))]
    rows += [(700, "short item: the answer is forty-two, indeed")]
    more = items.select("item_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "answer is forty-two")], "item_id long, text string"))
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), more).collect()}
    assert all(got[d, i] == 0 for d, i in want if d < 300)
    assert len(want & set(got)) >= 0.97 * len(want) and got[700, -3] == 0
    assert all(d is None or d < 500 or (d, i) == (700, -3) for d, i in got)
    assert decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), more.where("false")).count() == 0


def test_edited_items_are_found(spark):
    """Insertions, deletions and substitutions of up to 15 % of an item, one copy of each in four, and long, empty and repeated texts."""
    items = [r for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect() if r.text]
    host = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id = 3").first().text
    rng, rows = np.random.default_rng(5), []
    for k, ratio in enumerate((0.05, 0.1, 0.12, 0.145)):
        for n, r in enumerate(items):
            x = decontaminate.normal(r.text)
            rows.append((k * 1000 + n, f"{host} {decontaminate.edited(x, int(ratio * len(x)), rng)} {host}"))
    rows += [(9000, ""), (9001, None), (9002, f"{host} " * 300 + items[0].text), (9003, items[1].text), (9003, items[1].text)]
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items)).collect()]
    for k in range(4):
        assert sum((k * 1000 + n, r.item_id) in got for n, r in enumerate(items)) >= 0.95 * len(items), k
    assert (9002, items[0].item_id) in got and got.count((9003, items[1].item_id)) == 2 and not {9000, 9001} & {d for d, _ in got}


# -- 7 quality -----------------------------------------------------------------------------------------
def test_gradients():
    r = np.random.default_rng(0)
    net = quality.Net.fresh()
    for name in ("embed", "filters", "bias", "out"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.bias[:] = r.uniform(0.1, 0.3, len(net.bias))  # off the kink of an empty text
    data, offsets = r.integers(1, 256, 700).astype(np.uint8), np.array([0, 300, 300, 700])
    y, w = np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.3, 0.2])
    loss = lambda: float(-(w * (y * np.log(p := net.predict(data, offsets)) + (1 - y) * np.log(1 - p))).sum())
    for p, g in zip((net.filters, net.bias, net.out), net.gradients(data, offsets, y, w)[1:]):
        for _ in range(5):
            k = tuple(int(r.integers(n)) for n in p.shape)
            was, step = p[k], 1e-4
            p[k] = was + step
            up = loss()
            p[k] = was - step
            down = loss()
            p[k] = was
            assert abs((up - down) / (2 * step) - g[k]) < 2e-3


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op7_quality"](spark, "/root/testdata/sf0.01").collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(got) == docs.count() and all(got[r.doc_id].held_out for r in held)
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (None, "y")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in quality.score(odd, quality.Net.fresh()).collect())
    assert {r.score for r in quality.score(odd, quality.fit(odd, labels.where("false"))).collect()} == {0.5}


# -- 8 html --------------------------------------------------------------------------------------------
def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_html(spark):
    art = "<article><h1>Head &amp; more</h1><p>One\n two<p>three &lt;b&gt; <b>four</b><br>five<script>if (a<b) x('</p>')</script><ul><li>six<li>seven</ul><aside>no</aside><div class='ad'>no</div></article>"
    want = "Head & more\n\nOne two\n\nthree <b> four five\n\nsix\n\nseven"
    cases = {
        1: (page("<nav><a>no</a></nav>" + art + "<footer>no</footer><section id='comments'><article class='comment'>no no no</article></section>"), want),
        2: (page("<div class='cookie-notice'>no</div><div id='content'><p>text</p></div><div class='sidebar'>no</div><form>no<input></form>"), "text"),
        3: (page("<header>no</header><main><p>a</p><p>b</p></main>"), "a\n\nb"),
        4: (None, ""), 5: ("", ""), 6: ("just &eacute; text", "just é text"), 7: ("<p>open <div>x", "open\n\nx"), 8: ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"), 9: (page("<!-- c --><p>&#8364;&nbsp;x</p>"), "€ x"),
    }
    rows = [(k, "http://a.example/x", h) for k, (h, _) in cases.items()] + [(90, None, page("<p>q</p>")), (90, None, page("<p>q</p>"))]
    got = sorted(htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert {r.page_id: r.text for r in got} == {k: w for k, (_, w) in cases.items()} | {90: "q"} and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)


def test_html_odds():
    text = lambda body: htmltext.main_text(page(body))
    assert text("<article><p>one</p></article><div>no</div><article><p>two</p></article>") == "one\n\ntwo"
    assert text("<article><p class='side effects'>a</p><div class='popular-science'>b</div><div class='search algorithm'>c</div><p class='ad'>no</p><h2 class='menu'>d</h2><p class='ad hoc'>e</p></article>") == "a\n\nb\n\nc\n\nd\n\ne"
    assert text("<article><div class='site-footer x9'>no</div><div class='notice box'>no</div><ul class='share-buttons'><li>no</ul><p>a</p></article>") == "a"
    assert text("<article><p>a <a title=\"x>link</a> b</p><p>c</p></article>") == "a link b\n\nc"
    assert text("<article><p title='1 > 0'>a < b</p><p>5<6</p></article>") == "a < b\n\n5<6"
    assert text("<main><p>x</p></main><article></article>") == "x"  # an article without text is none
    for odd in ("<div class=content>" * 4000 + "x", "<b>" * 20000 + "x", "<p \"" * 8000, "<a '" * 8000 + ">x", "<" * 20000, "<li>x" * 5000):
        began = time.time()
        htmltext.main_text(odd)
        assert time.time() - began < 2


def test_templates_go(spark):
    shell = "<div class='x1'><p>Welcome to our site</p></div><div class='x2'>{}</div><div class='x3'>All rights kept</div>"
    rows = [(k, f"https://u@Host.example:80/{k}", page(shell.format(f"<p>story {k}</p>"))) for k in range(12)] + [(50, "https://other.example/", page(shell.format("<p>one</p>")))]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"story {k}" for k in range(12)) and "Welcome" in got[50]


def test_templates_in_articles_go(spark):
    box = "<div class='x9'><p>Get our letter</p><ul><li>once a week</ul></div>"
    art = "<article><h1>story {0}</h1><p>Breaking:</p><p>it is {0}</p>{1}<div>told by us</div><p>end {0}</p></article>"
    rows = [(k, f"https://a.example/{k}", page(art.format(k, box))) for k in range(8)]
    same = "<article><section class='s'><h2>a</h2><p>b c d e</p></section><section class='s'><p>f g h i</p></section></article>"
    rows += [(20 + k, f"https://b.example/{k}", page(same)) for k in range(8)]
    rows += [(40 + k, f"https://c.example/{k}", page(f"<main><p>text {k}</p>{box}</main>")) for k in range(3)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"story {k}\n\nBreaking:\n\nit is {k}\n\ntold by us\n\nend {k}" for k in range(8))
    assert all(got[20 + k] == "a\n\nb c d e\n\nf g h i" for k in range(8))
    assert all("Get our letter" in got[40 + k] for k in range(3))


# -- 9 language model ----------------------------------------------------------------------------------
def test_elias_fano():
    r = np.random.default_rng(0)
    for top in (1, 50, 1 << 20, (1 << 64) - 1):
        x = np.unique(r.integers(0, top, 3000, dtype=np.uint64, endpoint=True))
        e = ngramlm.EliasFano(*ngramlm.EliasFano.code(x))
        assert (e[np.arange(len(x))] == x).all() and (e.find(x) == np.arange(len(x))).all()
        other = r.integers(0, top, 3000, dtype=np.uint64, endpoint=True)
        assert ((e.find(other) >= 0) == np.isin(other, x)).all()
    assert (ngramlm.EliasFano(*ngramlm.EliasFano.code(np.zeros(0, np.uint64))).find(np.array([1, 2], np.uint64)) == -1).all()


@pytest.mark.parametrize("hot", [1e9, 30])
def test_language_model(spark, some, hot, monkeypatch):
    monkeypatch.setattr(ngramlm, "BLOCK_TOKENS", 20_000)
    monkeypatch.setattr(ngramlm, "COMMON", 2.0**-12)
    if hot < 1e9:  # frequent words are spread
        monkeypatch.setattr(ngramlm, "size_for", lambda tokens, least: 4 * hot if least == ngramlm.PIECE_TOKENS else least)
    docs = docs_of(spark, some).withColumn("train", F.coalesce(F.col("doc_id") % 3 != 1, F.lit(True)))
    texts = [(d, WORD.findall(low(t)) + ["</s>"], d is None or d % 3 != 1) for d, t, *_ in some]
    c = Counter(w for _, ws, train in texts if train for w in ws)
    n, v = sum(c.values()), len(c)
    grams, pairs, two, one = Counter(), Counter(), Counter(), Counter()
    events = lambda ws: list(zip(["<s>", "<s>", *ws], ["<s>", *ws], ws))
    for _, ws, train in texts:
        for x, y, z in events(ws) if train else ():
            grams[x, y, z] += 1
            two[x, y] += 1
            pairs[y, z] += 1
            one[y] += 1
    want = []
    for d, ws, _ in texts:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        p2 = lambda y, z: (pairs[y, z] + ngramlm.K2 * (c[z] + 1) / (n + v + 1)) / (one[y] + ngramlm.K2)
        score = sum(math.log10((grams[x, y, z] + ngramlm.K3 * p2(y, z)) / (two[x, y] + ngramlm.K3)) for x, y, z in events(ws))
        want.append((-1 if d is None else d, len(ws), sum(c[w] > 0 for w in ws), n, base, score))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngramlm.score_texts(docs).collect()]
    assert len(got) == len(want)
    for g, w in zip(sorted(got), sorted(want)):
        assert g[:4] == w[:4] and math.isclose(g[4], w[4], rel_tol=1e-9) and abs(g[5] - w[5]) < 0.03 * w[1] + 0.03
    assert ngramlm.score_texts(docs.where("false")).count() == 0
    assert {r.n_known for r in ngramlm.score_texts(docs.withColumn("train", F.lit(False))).collect()} == {0}


def test_trie():
    """Every n-gram is found at its own place by its context, and nothing else is."""
    r = np.random.default_rng(0)
    grams = {tuple(map(int, x)) for x in r.integers(0, 30, (2000, 3))}  # w2, w1, w3
    contexts = sorted({g[0] for g in grams})
    rank = {c: i for i, c in enumerate(contexts)}
    after, born = sorted({(rank[a], c) for a, _, c in grams}), sorted({(rank[a], b) for a, b, _ in grams})
    ordered = sorted(grams)
    key = lambda xs: np.array([(a << 33) | b for a, b in xs], np.uint64)
    child, last = np.array([born.index((rank[a], b)) for a, b, _ in ordered]), np.array([after.index((rank[a], c)) for a, _, c in ordered])
    trie = ngramlm.Trie(np.array(contexts, np.uint64) * np.uint64(10**17), key(after), key(born), child, last, {"gram": (np.arange(len(ordered)) % 255 + 1).astype(np.uint8)})
    asked = [(a, b, c) for a in range(30) for b in range(32) for c in range(32)]
    a, b, c = (np.array(x, np.uint64) for x in zip(*asked))
    at = trie.levels["contexts"].find(a * np.uint64(10**17))
    got = trie.gram(at, trie.find("children", at, b), trie.find("successors", at, c))
    place = {g: i for i, g in enumerate(ordered)}
    assert got.tolist() == [place.get(g, -1) for g in asked]
    assert (trie.code("gram", got)[got < 0] == 0).all()
    trie.close()


def test_packed_arrays():
    arrays = [np.array([1, 2**63], np.uint64), np.zeros(0, np.int32), np.array([7], np.uint8)]
    for x, y in zip(arrays, ngramlm.unpack(ngramlm.pack(*arrays), "u8", "i4", "u1")):
        assert (x == y).all() and len(x) == len(y)
    n = np.array([0, 254, 255, 256, 10**12])
    assert (ngramlm._counts(*ngramlm._pack_counts(n)) == n).all()


# -- 10 join -------------------------------------------------------------------------------------------
def brute(rows, k, num, den):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall(low(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and den * both >= num * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), len(s), str(least.get(find(i)))) for i, (r, s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("tile", [(2_000_000, 4096), (300, 2)])
def test_join(spark, some, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", tile[0])
    monkeypatch.setattr(jaccard, "TILE_SETS", tile[1])
    r = np.random.default_rng(0)
    rows = list(some)
    for d in range(40):  # copies at many distances
        words = some[d % 8][1].split()[:120]
        for _ in range(d % 10):
            words[r.integers(len(words))] = f"new{r.integers(9)}"
        rows.append((1000 + d, " ".join(words), "en", "s"))
    got = jaccard.jaccard_components(docs_of(spark, rows), 3, 90, 100).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute(rows, 3, 90, 100)
    assert jaccard.jaccard_components(docs_of(spark, [])).count() == 0


def test_join_of_large_ids_beside_nulls(spark):
    """Ids over 2**53, which doubles do not tell apart."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(2**60 + 2 * k + 1, text(k), None, None) for k in range(9)] + [(2**60 + 100 + k, text(k) + " more", None, None) for k in range(9)] + [(None, "no id here", None, None)]
    got = jaccard.jaccard_components(docs_of(spark, rows).coalesce(1), 3, 90, 100).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute(rows, 3, 90, 100)


def test_join_holds_one_worker_a_task_and_small_batches(spark, some, monkeypatch):
    """No plan of the join has two Python steps in a stage, and none of its batches is 10,000 rows of any length."""
    key, seen, keep = "spark.sql.execution.arrow.maxBytesPerBatch", [], jaccard.stored
    was = spark.conf.get(key, None)

    def stored(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen.append((name, plan.count("ArrowEvalPython"), spark.conf.get(key, None)))
        return keep(df, name)

    monkeypatch.setattr(jaccard, "stored", stored)
    rows = [*some, (910, f"{some[0][1]} more", None, None)]
    got = jaccard.jaccard_components(docs_of(spark, rows), 3, 90, 100).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute(rows, 3, 90, 100)
    assert {"jaccard-keys", "jaccard-listed", "jaccard-arrays"} <= {n for n, *_ in seen}
    assert all(not n and most and int(most) <= 1 << 23 for _, n, most in seen)
    assert spark.conf.get(key, None) == was
    long = spark.range(4000).repartition(1).select(F.repeat(F.lit("word "), 1000).alias("t"))
    with arrow_bytes(spark, 1 << 20):
        sizes = [r.n for r in map_arrow(long, lambda b: [pa.record_batch([pa.array([b.nbytes])], names=["n"])], "n long").collect()]
    assert len(sizes) > 15 and max(sizes) < 1 << 21


def test_arrow_bloom(spark):
    has = arrow_bloom(spark.createDataFrame([(2**60 + 1,), (5,), (None,)], "id long"))
    assert has(pa.array([2**60 + 1, 5, None], pa.int64())).tolist() == [True] * 3
    assert has(pa.array(range(1000, 2000), pa.int64())).sum() < 100 and not len(has(pa.array([], pa.int64())))


def test_long_words_of_a_regular_pattern_differ(spark):
    """Words of 1,024 letters whose sums of powers are equal modulo 2**64."""
    word = lambda a, b: "".join((a, b)[k.bit_count() & 1] for k in range(1024))
    rows = [(1, f"x y {word('a', 'b')}", None, None), (2, f"x y {word('b', 'a')}", None, None), (3, f"X y {word('A', 'b')}", None, None)]
    got = jaccard.jaccard_components(docs_of(spark, rows), 3, 90, 100).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute(rows, 3, 90, 100)


def test_bound_never_hides_a_link():
    r = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(r.integers(0, 400, 60).astype(np.uint64))
        b = np.unique(np.concatenate([r.choice(a, 50), r.integers(0, 400, r.integers(0, 9)).astype(np.uint64)]))
        m = jaccard.bitmaps([a, b], 256)
        if jaccard.links(a, b, 80, 100):
            assert jaccard.may_link(m[0], len(a), m[1:], np.array([len(b)]), 80, 100)[0]
            p, q = a[: jaccard.prefix_length(len(a), 80, 100)], b[: jaccard.prefix_length(len(b), 80, 100)]
            assert len(np.intersect1d(p, q)) >= min(jaccard.shared_least(len(a)), jaccard.shared_least(len(b)))


def test_one_of_each(spark, some):
    kept = jaccard.one_of_each(docs_of(spark, some))
    ids = [r.doc_id for r in kept.collect()]
    assert 903 not in ids and 900 in ids and None in ids and len(ids) == len(set(ids))
    assert kept.columns == docs_of(spark, []).columns


def test_one_of_each_of_repeated_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, text(1)), (1, text(2)), (1, text(1)), (2, text(2)), (3, text(3)), (3, text(3) + " more"), (4, ""), (4, None), (5, text(1)), (5, text(6)), (None, text(1)), (None, text(1))]
    got = Counter((r.doc_id, r.text) for r in jaccard.one_of_each(docs_of(spark, [(*r, None, None) for r in rows])).collect())
    assert got[None, text(1)] == 2 and got[5, text(6)] == 1 and (2, text(2)) not in got and (5, text(1)) not in got
    assert sum(n for (d, _), n in got.items() if d == 1) == 2 and sum(n for (d, _), n in got.items() if d == 3) == 1
    assert got[4, ""] + got[4, None] == 1


# -- pipeline ------------------------------------------------------------------------------------------
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("label", F.lit(1))
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        assert before * 0.6 < docs.count() <= before
    got = corpus_pipeline.mixing(spark, docs, SF)
    assert got.columns == [*docs.columns, "copies"]
    assert 0 < got.count() <= docs.count() and got.where("copies NOT IN (1, 2) OR text IS NULL").count() == 0
    assert got.drop("copies").exceptAll(docs).count() == 0
