"""Mixing, secrets, HTML, toxicity, decontamination and token counts on small fixtures, with their edge cases."""

import hashlib
import html
import re
import time
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from gneiss.llm import decontam, mixing, rollup, secrets, toxicity
from gneiss.llm import html as pages_
from gneiss.llm.common import hash_words, raw_bytes, word_bounds

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema)


def test_words_are_cut_and_hashed_alike():
    texts = ["A b\tc", "", None, "éÉ a", "x" * 5000, " lead trail ", "B C a b"]
    data, offsets = raw_bytes(pa.array(texts))
    starts, ends, of = word_bounds(data, offsets)
    h = hash_words(data, starts, ends)
    by = {}
    k = 0
    for t in texts:
        for w in WORD.findall(t or ""):
            low = "".join(c.lower() if c.isascii() else c for c in w)
            assert by.setdefault(low, h[k]) == h[k]
            k += 1
    assert k == len(h) == of[-1] and len(set(by.values())) == len(by)


# ---- mixing


def expected_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = budget - epochs * sum(sizes[s] for s in capped)
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > epochs * sizes[s]}
        if not over:
            return {**{s: epochs * sizes[s] for s in capped}, **t}
        capped |= over


def test_mix_meets_targets_and_agrees_with_itself(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["b", "a", None, "é", "z"][min(4, int(rng.integers(0, 9)))]) for i in range(400)]
    rows += [(900, None, "a"), (901, "", "nothing"), (7, rows[7][1], rows[7][2])]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = expected_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes)
    again = mixing.mix(docs_of(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_of_nothing_and_of_clashing_columns(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    d = spark.createDataFrame([(1, "a b", "s", 5, 6.0)], "doc_id long, text string, source string, size long, target double")
    out = mixing.mix(d, whole_rows=True)
    assert sorted(out.columns) == sorted(["doc_id", "source", "size", "source_size", "target", "taken", "text"]) and out.first().size == 2


# ---- secrets

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_secrets_match_brute_force(spark):
    texts = [
        None, "", "password: token=abcdef1 é", 'API_KEY = "abcdefgh" Apikey:\'zzzzzz\'', "AKIA" + "A1" * 8 + " AKIASHORT", "é" * 50 + "0123456789abcdef01234567",
        "ſecret=abcdefgh toKen=abcdefg", "x" * 100_000 + " secret=" + "a" * 40, "passwd : 'a/b+c_d.e=f-g'", "0123456789abcdef0123456 7", "token=aaaaaa" * 3,
    ]
    kinds = ["assign", "access", "hex"]
    got = secrets.scan(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    for r, t in zip(sorted(got, key=lambda r: r.doc_id), texts):
        want = brute(t or "")
        said = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))


def test_trigram_queries_never_lose_a_match():
    samples = {
        "pem": "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "jwt": "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM", "github": "ghp_" + "a" * 36,
        "slack": "xoxb-1234567890", "urlcred": "https://user:pass@host", "assign": "ApI_Key='abcdef'", "access": "AKIA" + "A" * 16, "hex": "0" * 24,
    }
    for rule in secrets.RULES:
        q = secrets.trigram_query(rule.pattern)
        text = pa.array(["nothing", "xx " + samples[rule.kind] + " yy"], pa.large_string())
        rows = secrets.answer(q, secrets.postings(text, secrets.trigrams(q)))
        assert rows is None or rows.tolist() == [1]
        assert (q == secrets.ANY) == (rule.kind == "hex")
        assert any(k == i for spans in secrets.find(text).values() for _, k, _ in spans for i in [secrets.RULES.index(rule)])


def test_postings_match_brute_force():
    rng = np.random.default_rng(3)
    alphabet = list("abcAK_-: é.")
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 60)))) for _ in range(300)] + ["", "ab", "c" * 4000 + "abc"]
    names = {"".join(rng.choice(list("abck_-: ."), 3)) for _ in range(60)} | {"abc"}
    got = secrets.postings(pa.array(texts, pa.large_string()), names)
    assert {k: v.tolist() for k, v in got.items()} == {k: [i for i, t in enumerate(texts) if k in t.lower()] for k in names}
    assert all(not len(v) for v in secrets.postings(pa.array([], pa.large_string()), names).values())


def test_every_rule_on_its_own_scan():
    """The spans of all rules, found by the index, against a search of every text for every rule."""
    rng = np.random.default_rng(8)
    pieces_ = ["eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM", "ghp_" + "a" * 36, "xoxb-1234567890", "https://user:pass@host", "ApI_Key='abcdef'", "AKIA" + "A" * 16, "0" * 24, " ", "é", "x.", "-", "\n", "://", "eyJ", "9http://a:bcd@e", "-----BEGIN PRIVATE KEY-----ab\n-----END PRIVATE KEY-----"]
    texts = ["".join(rng.choice(pieces_, 12)) for _ in range(200)]
    got = secrets.find(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        assert got.get(i, []) == sorted((a, k, b) for k, r in enumerate(secrets.RULES) for a, b in r.spans(t))


@pytest.mark.parametrize(
    "text",
    ["x" * 1_000_000 + "://", "eyJ" * 400_000 + ".eyJ", "a" * 500_000 + "://b:" + "c" * 500_000, "http://" * 150_000, "eyJaaaaaaaa." * 90_000, "-----BEGIN " + "A " * 500_000, "password" + " " * 1_000_000, "://" + ":" * 1_000_000, "0123456789abcdeg" * 70_000],
)
def test_long_runs_are_read_once(text):
    began = time.process_time()
    secrets.find(pa.array([text], pa.large_string()))
    assert time.process_time() - began < 5


def test_secrets_of_nothing_of_repeats_and_of_clashing_columns(spark):
    assert secrets.scan(docs_of(spark, [])).count() == 0 and secrets.redact(docs_of(spark, [])).count() == 0
    d = spark.createDataFrame([(1, "token=abcdefgh", 3, "x")] * 2 + [(None, None, 3, "x")], "doc_id long, text string, n_hex int, spans string")
    got = secrets.scan(d).collect()
    assert sorted((r.doc_id or 0, r.n_assign, r.n_hex, r.spans) for r in got) == [(0, 0, 0, ""), (1, 1, 0, "assign:0:14"), (1, 1, 0, "assign:0:14")]
    assert secrets.redact(d).columns == d.columns and {r.spans for r in secrets.redact(d).collect()} == {"x"}


def test_redaction_keeps_rows_and_counts_again(spark):
    got = secrets.redact(docs_of(spark, [(1, "é token=abcdefgh end", "s"), (2, None, "s"), (3, "clean", "s")])).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["é [assign] end", None, "clean"] and got[0].n_chars == len("é [assign] end")


# ---- HTML

LONG = "Some sentence of the article that goes on for a while, with words. " * 3


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("<html></html>", ""), ("just &lt;text&gt;", "just <text>"),
        (f"<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{LONG}<p>End.</article><footer>f</footer>", f"Title\n{LONG.strip()}\nEnd."),
        (f"<body><div class='header'>Site</div><div class=content><h2>T</h2><p>{LONG}</p><div class=sidebar>s</div><p>{LONG}</p><p>E.</p></div><div id=comments><p>{LONG * 4}</p></div></body>", f"T\n{LONG.strip()}\n{LONG.strip()}\nE."),
        (f"<article><script>var a='</p>';</script><p>{LONG}</p><form><p>Name</p></form><aside>x</aside><p>a &amp;amp; b", f"{LONG.strip()}\na &amp; b"),
        (f"<article><p>{LONG}</p><div class='related-work'>Smith did it.</div><div class=toc>One. Two.</div><p>So <math><mi>x</mi></math> is.</p><div class=ad>Buy</div><p>End</p></article>", f"{LONG.strip()}\nSmith did it.\nOne. Two.\nSo x is.\nEnd"),
        ("<p><a href=x>One</a></p><p><a href=y>Two</a></p>", "One\nTwo"),
    ],
)
def test_main_text(page, want):
    assert pages_.main_text(page) == want


def test_article_bounds_only_its_own_stretch():
    card = f"<article><h2>More</h2><p>{LONG}</p></article>"
    main = "".join(f"<p>Part {k}. {LONG}</p>" for k in range(3))
    text = "\n".join(f"Part {k}. {LONG.strip()}" for k in range(3))
    page = f"<body><div id=content><h1>Title</h1>{main}</div><nav>menu</nav>{card}<nav>menu</nav>{card}</body>"
    assert pages_.main_text(page) == f"Title\n{text}"
    assert pages_.main_text(f"<body><div>{LONG}</div><nav>menu</nav><article><h1>Title</h1>{main}</article></body>") == f"Title\n{text}"


def test_extract_counts_code_points_of_every_row(spark):
    rows = [(1, "u", f"<article><p>é {LONG}</p></article>"), (1, "u", None), (None, None, "<p>" + "x " * 50_000)]
    got = pages_.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.n_chars for r in got) == sorted([len(f"é {LONG.strip()}"), 0, 99_999])
    assert pages_.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def planted(page):
    """The article of a given page, cut out by its tags."""
    inside = re.sub(r"</?(b|br)>", " ", page[page.index("<article>") + 9 : page.index("</article>")])
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inside))
    return "\n".join(b for b in blocks if b)


def test_main_text_of_the_given_pages(spark):
    """As they are, with a division for the article, and with divisions for all that says what an element is."""
    given = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    divided = [p.replace("<article", "<div").replace("</article", "</div") for p in given]
    bare = [re.sub("<(/?)(article|nav|footer)", r"<\1div", p).replace(' class="ad"', "") for p in given]
    want = list(map(planted, given))
    assert list(map(pages_.main_text, given)) == want and list(map(pages_.main_text, divided)) == want
    right = lambda width, surge: np.mean([pages_.main_text(p, width, surge) == w for p, w in zip(bare, want)])
    assert right(pages_.WIDTH, pages_.SURGE) > 0.98  # an article shorter than its footer is lost
    assert right(99, pages_.SURGE) < 0.1 and right(pages_.WIDTH, 2) == 0  # window and threshold decide
    assert not any(pages_.main_text(p, surge=2) for p in given)


def test_windows_match_brute_force():
    rng = np.random.default_rng(4)
    for width in (1, 2, 3, 5, 8):
        w = rng.integers(0, 9, 30).tolist()
        assert pages_.window_sums(w, width) == [sum(w[j] for j in range(30) if i - width // 2 <= j < i - width // 2 + width) for i in range(30)]
    assert pages_.window_sums([], 3) == []


def test_extract_ignores_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a</p>", "x", 7)] * 2, "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in pages_.extract(rows).collect()] == [(1, "u", "a", 1)] * 2


# ---- toxicity


def test_toxicity_learns_and_holds_out(spark):
    rng = np.random.default_rng(3)
    good, bad = ["river", "stone", "cloud", "green", "table", "window", "garden"], ["idiotic", "wretched", "despicable"]
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        words = list(rng.choice(good, 30)) + (list(rng.choice(bad, 3)) if toxic else [])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, "river idiottic stone despicablle cloud wretchedd table", "s"), (1001, None, "s"), (1002, "", "s"), (None, "river", "s")]
    docs = docs_of(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(300) if crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in range(300))
    assert np.mean([got[i].predicted == (i % 3 == 0) for i in held]) > 0.97
    assert got[1000].predicted == 1 and 0 <= got[1001].score <= 1 and got[1001].score == got[1002].score
    left = {r.doc_id for r in toxicity.clean(docs, model).collect()}
    assert left == {i for i, r in got.items() if not r.predicted}


def test_toxicity_without_usable_labels(spark):
    docs = docs_of(spark, [(1, "a b", "s"), (2, None, "s")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    odd = spark.createDataFrame([(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, odd)).collect()} == {0.5}


def test_clean_keeps_all_if_nothing_was_learnt(spark):
    docs = docs_of(spark, [(1, "a b", "s"), (2, None, "s"), (3, "c", "s")])
    for rows in ([], [(i, 1, 1) for i in (1, 2, 3)]):
        model = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert toxicity.clean(docs, model).count() == 3


def test_a_long_text_leaves_the_others_in_the_sample(spark):
    rows = [(i, "wretched fool" if i % 2 else "green river", "s") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(41)], "doc_id long, quality int, toxic int")
    first = spark.sql("select id from range(41) order by xxhash64(id)").toPandas()["id"].tolist()
    long_ = next(i for i in first if crc32(str(i).encode()) % 5)  # the first of the sample
    docs = docs_of(spark, [(i, "x " * 2_000 if i == long_ else t, s) for i, t, s in rows] + [(40, "x " * 2_000, "s")])
    model = toxicity.fit(docs, labels, sample_bytes=2_000)
    assert model.score("wretched fool") > 0.5 > model.score("green river")
    assert not toxicity.fit(docs, labels, sample_bytes=5).learnt


def brute_score(model, text):
    """The average over the distinct words' n-grams, one by one."""
    m64 = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m64
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m64
        return x ^ (x >> 31)

    def whole(w):
        p, h, base = 1, 0, 0x9E3779B97F4A7C15
        for c in w:
            h, p = (h + (c + 1) * p) & m64, (p * base) & m64
        return mix(mix(h ^ (len(w) * base & m64)))

    weights = []
    for w in set(re.findall("[a-zß-öø-ÿÀ-ÖØ-Þ]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)])), "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xE0, 0xF7), *range(0xF8, 0xFF)])))))):
        raw = w.encode()
        weights.append(model.weight[whole(raw) % len(model.weight)])
        marked = b"<" + raw + b">"
        for k in toxicity.SIZES:
            for i in range(len(marked) - k + 1 if len(marked) > k else 0):
                h = 0
                for c in marked[i : i + k]:
                    h = (h * 0x100000001B3 + c) & m64
                weights.append(model.weight[mix((h + k) & m64) % len(model.weight)])
    return 1 / (1 + np.exp(-(model.bias + (np.mean(weights, dtype=float) if weights else 0))))


def test_scores_match_brute_force():
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(0, 3, toxicity.BUCKETS).astype(np.float32), -0.3)
    texts = [None, "", "a", "ab ab AB", "Élan vital — naïve; ¿qué? it's x2y", "l'école 12 «zwölf»", "word " * 3000 + "idiot", "x" * 50_000, "\x85 ½ ª"]
    texts += [" ".join("".join(rng.choice(list("abcdeÄé-'.7"), int(rng.integers(1, 12)))) for _ in range(40)) for _ in range(30)]
    assert np.allclose(model.scores(pa.array(texts)), [brute_score(model, t) for t in texts], atol=1e-5)


def test_toxicity_of_nothing_repeats_and_clashing_columns(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)] * 2 + [(3, 1, 0)], "doc_id long, text int, toxic int")
    docs = spark.createDataFrame([(i, "wretched fool" if i % 2 else "green river", 0.5, "x") for i in range(30)] * 2, "doc_id long, text string, score double, toxic string")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 60 and all(r.predicted == r.doc_id % 2 for r in got)
    left = toxicity.clean(docs, model)
    assert left.columns == docs.columns and left.count() == 30
    assert toxicity.score(docs.limit(0), model).count() == 0 and not toxicity.fit(docs.limit(0), labels).learnt


@pytest.mark.parametrize("n", [40, 80])
def test_words_of_one_text_teach_their_ngrams(n):
    end = lambda i: "".join("abcdefghij"[int(x)] for x in f"{i:02}")
    texts = [f"{'wretched' if i % 2 else 'peaceful'}{end(i)}" for i in range(n)]
    model = toxicity.train(texts, np.arange(n) % 2.0)
    assert model.score("wretchedzz") > 0.9 and model.score("peacefulzz") < 0.1


def test_toxicity_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = toxicity.op5_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    order = got["score"].rank()
    pos = got["toxic"] == 1
    auc = (order[pos].mean() - (pos.sum() + 1) / 2) / (~pos).sum()
    assert auc > 0.75


# ---- decontamination

ITEM = "A train leaves at 9 with Anna aboard and travels 120 km to reach Bob before Anna gets tired of it."


@pytest.mark.parametrize(
    "text, hit, changed",
    [
        ("Well. " + ITEM + " Done.", True, False), (ITEM.upper(), True, None), ("x " * 50_000 + ITEM, True, False), (None, False, None), ("", False, None),
        (ITEM.replace("Anna", "Carl").replace("Bob", "Dora").replace("9", "7").replace("120", "300"), True, True),
        (ITEM.replace("Anna", "Carl", 1).replace("Bob", "Dora").replace("120", "300"), False, None), ("A train leaves at 9 with", False, None),
    ],
)
def test_templates(spark, text, hit, changed):
    bench = decontam.Benchmark([5], pa.array([ITEM]), 8)
    data, at = raw_bytes(pa.array([text], pa.string()))
    got = list(bench.hits(*decontam.tokens(data, at)))
    assert bool(got) == hit and (changed is None or got[0][4] == changed)


def hits_of(item, text):
    data, at = raw_bytes(pa.array([text], pa.string()))
    return list(decontam.Benchmark([5], pa.array([item]), 8).hits(*decontam.tokens(data, at)))


@pytest.mark.parametrize("value, other", [("5", "6"), ("Anna", "Carl")])
def test_literal_copy_counts_despite_inconsistent_slots(value, other):
    words = [f"w{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}" for k in range(60)]
    words[10] = words[30] = value
    copy = words[5:45]
    assert hits_of(" ".join(words), " ".join(copy))[0][4] is False
    copy[25] = other
    assert [(t, i) for t, i, n, *_ in hits_of(" ".join(words), " ".join(copy)) if n >= 25] == [(0, 0)]


JANET = "Janet has 5 apples. Janet gives Tom 2 of them. Janet then eats 1 and asks Tom how many are left."
BOXES = "There are 2 boxes on each shelf and 2 dollars buy one, so what is left?"
EGGS = "A farmer sells 3 ducks and 5 hens then goes home again."


@pytest.mark.parametrize(
    "item, text, hit",
    [
        (JANET, JANET.replace("Janet", "Maria").replace("Tom", "Ali").replace("5", "8"), True),
        (JANET, "Question: " + JANET.replace("Janet", "Maria").replace("Tom", "Ali"), True),
        (BOXES, BOXES.replace("2 boxes", "3 boxes").replace("2 dollars", "4 dollars"), True),
        (EGGS, EGGS.replace("3", "4").replace("5", "4"), True),
        (JANET, JANET.replace("Janet", "Maria", 1).replace("Tom", "Ali", 1).replace("1", "3"), False),
        (ITEM, ITEM.replace("Anna", "Bob").replace("9", "8"), False),
    ],
)
def test_other_names_and_numbers(item, text, hit):
    assert bool(hits_of(item, text)) == hit


COINS = "Maria has seven coins and gives three of them to her friend Tom, so how many coins does she keep?"


def test_number_words_are_slots():
    other = COINS.replace("seven", "nine").replace("three", "two").replace("Maria", "Lena").replace("Tom", "Ben")
    assert hits_of(COINS, other)[0][4] is True and hits_of(COINS, other.replace("nine", "9"))[0][4] is True
    assert not hits_of(COINS, other.replace("coins", "marbles").replace("friend", "brother").replace("keep", "lose"))


def planted_questions(n=60, seed=5):
    """Questions, and each asked anew with other names, numbers and units in a text of its own."""
    rng = np.random.default_rng(seed)
    plain = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in ("rt", "ns", "lk", "st")]
    names, units = ["Anna", "Boris", "Carla", "Dmitri", "Elena", "Farid", "Greta", "Hugo"], ["km", "miles", "hours", "kg"]
    numbers = ["2", "3", "7", "12", "45", "1,200", "0.5", "four", "nine", "twenty"]
    questions, texts = [], []
    for _ in range(n):
        words = list(rng.choice(plain, 28))
        at = [k * 4 + int(rng.integers(1, 5)) for k in range(6)]
        kinds = ["name", "number", "number", "name", "number", "unit"]
        fill = []
        for _ in range(2):
            w = list(words)
            who = list(rng.permutation(names)[:2])
            for p, kind in zip(at, kinds):
                w[p] = who.pop() if kind == "name" else f"{rng.choice(numbers)} {rng.choice(units)}" if kind == "unit" else str(rng.choice(numbers))
            w[0] = w[0].capitalize()
            fill.append(" ".join(w) + "?")
        questions.append(fill[0])
        texts.append(" ".join(rng.choice(plain, 80)) + ". " + fill[1] + " " + " ".join(rng.choice(plain, 80)))
    return questions, texts


def test_asked_anew_is_found_by_templates(spark):
    questions, texts = planted_questions()
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    bench = spark.createDataFrame(list(enumerate(questions)), "item_id long, text string")
    pairs = lambda **x: {(r.doc_id, r.item_id) for r in decontam.find(docs, bench, **x).collect()}
    found, literal = pairs(), pairs(templates=False)
    assert found <= {(i, i) for i in range(60)}
    assert len(found) == 60 and len(literal) <= 6


def test_decontamination_of_repeats_and_clashing_columns(spark):
    bench = spark.createDataFrame([(5, ITEM, 1, 2.0)] * 2 + [(6, ITEM, 1, 2.0)], "item_id long, text string, words int, doc_id double")
    docs = spark.createDataFrame([(1, ITEM, "x", True)] * 2 + [(2, "clean", "x", True)], "doc_id long, text string, item_id string, changed boolean")
    assert sorted((r.doc_id, r.item_id) for r in decontam.find(docs, bench).collect()) == sorted([(1, 5)] * 4 + [(1, 6)] * 2)
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [2]


def test_decontamination_matches_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = {}
    for r in bench.collect():
        w = cut(r.text)
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(r.item_id)
    want = set()
    for r in docs.collect():
        w = cut(r.text)
        for k in range(len(w) - 12):
            want |= {(r.doc_id, i) for i in grams.get(tuple(w[k : k + 13]), ())}
    found = decontam.find(docs, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and want
    split = decontam.find(docs, bench, item_rows=9)  # blocks of the benchmark
    assert {(r.doc_id, r.item_id) for r in split.collect()} == want
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {r.doc_id for r in docs.collect()} - {i for i, _ in want}


def test_decontamination_of_nothing(spark):
    docs, none = docs_of(spark, [(1, ITEM, "s")]), spark.createDataFrame([], "item_id long, text string")
    assert decontam.find(docs, none).count() == 0 and decontam.clean(docs, none).count() == 1
    bench = spark.createDataFrame([(1, None), (2, "..."), (None, ITEM), (3, "ok")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.find(docs, bench).collect()] == [(1, None)]
    assert decontam.find(docs_of(spark, []), bench).count() == 0


# ---- token rollups


def test_rollup_counts_once_and_by_sign(spark, tmp_path):
    schema = "op string, source string, lang string, version string, tokens long, old_tokens long, docs string"
    r = rollup.Rollup(spark, f"file://{tmp_path}/rollup")
    first = spark.createDataFrame([("insert", "a", "en", "v1", 10, None, "x"), ("insert", "a", "en", "v1", 5, None, "x"), ("insert", None, "en", "v1", 7, None, "x")], schema)
    assert r.commit("one", first) and not r.commit("one", first)
    assert r.commit("two", spark.createDataFrame([("delete", "a", "en", "v1", 5, None, "x"), ("revise", "a", "en", "v1", 12, 10, "x"), (None, "a", "en", "v1", 99, None, "x"), ("delete", None, "en", "v1", 7, None, "x")], schema))
    assert r.commit("none", spark.createDataFrame([], schema))
    want = [("a", "en", "v1", 1, 12)]
    assert [tuple(x) for x in r.totals().collect()] == want
    r.compact()
    assert [tuple(x) for x in r.totals().collect()] == want and not r.commit("two", first)
    assert r.names() == {"one", "two", "none"}
    assert r.commit("four", first)
    r.compact()
    assert sorted((x.source or "", x.docs, x.tokens) for x in r.totals().collect()) == [("", 1, 7), ("a", 3, 27)]


def test_token_counts_of_whole_texts(spark):
    encode = rollup.encoding(rollup.TOKENIZER).encode_ordinary
    texts = ["hello world", None, "", "<|endoftext|> é", "a b  c\n" * 3000]
    got = {r.doc_id: r.tokens for r in rollup.count_tokens(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got == {i: len(encode(t)) if t else 0 for i, t in enumerate(texts)}


def test_rollup_query_matches_brute_force(spark):
    """All documents, inserted by a guess, revised, and the toxic ones moved, by group."""
    encode = rollup.encoding(rollup.TOKENIZER).encode_ordinary
    d = "/root/testdata/sf0.001"
    toxic = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").collect()}
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        key = ("toxic" if r.doc_id in toxic else r.source, r.lang, rollup.TOKENIZER.rsplit("/", 1)[-1])
        n, t = want.get(key, (0, 0))
        want[key] = n + 1, t + len(encode(r.text or ""))
    assert {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in rollup.op7_tokens(spark, d).collect()} == want and toxic


def test_rollup_of_odd_documents(spark, tmp_path):
    encode = rollup.encoding(rollup.TOKENIZER).encode_ordinary
    rows = [(1, "a b", "en", "s", 3, "x")] * 2 + [(None, None, None, None, 3, "x"), (2, "", "de", "s", 3, "x"), (3, "c " * 5000, "en", None, 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens int, op string")
    toxic = spark.createDataFrame([(1,), (99,)], "doc_id long")
    for name, table in (("some", docs), ("none", docs.limit(0))):
        r = rollup.Rollup(spark, f"file://{tmp_path}/{name}")
        rollup.ingest(table, toxic, r)
        got = {(x.source, x.lang): (x.docs, x.tokens) for x in r.totals().collect()}
        long_ = len(encode("c " * 5000))
        assert got == ({("toxic", "en"): (2, 2 * len(encode("a b"))), (None, None): (1, 0), ("s", "de"): (1, 0), (None, "en"): (1, long_)} if name == "some" else {})


def test_two_jobs_of_one_batch_count_once(spark, tmp_path, monkeypatch):
    """Both see no marker before they write."""
    schema = "op string, source string, lang string, version string, tokens long"
    batch = spark.createDataFrame([("insert", "a", "en", "v", 4)], schema)
    r = rollup.Rollup(spark, f"file://{tmp_path}/r")
    real = rollup.deltas

    def slow(changes):
        monkeypatch.setattr(rollup, "deltas", real)
        assert rollup.Rollup(spark, r.path).commit("b", batch)
        return real(changes)

    monkeypatch.setattr(rollup, "deltas", slow)
    r.commit("b", batch)
    assert len(r._markers("b")) == 2
    assert [(x.docs, x.tokens) for x in r.totals().collect()] == [(1, 4)]
    r.compact()
    assert [(x.docs, x.tokens) for x in r.totals().collect()] == [(1, 4)] and not r.commit("b", batch)
