"""Top-k, Jaccard join, components, chat repair, language model and pipeline on small fixtures, with their edge cases."""

import itertools
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gneiss.llm import chat, hpylm, jaccard, vafile
from gneiss.llm.components import connected_components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


# ---- top-k


def brute_top(rows, k=5, every=50):
    v = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    queries = {}
    for i, e in v:
        if i % every == 0:
            queries[i] = min((len(e), e), queries.get(i, (len(e), e)))
    out = set()
    for q, (d, e) in queries.items():
        s = sorted((-sum(a * b for a, b in zip(e, c)), i) for i, c in v if i != q and len(c) == d)
        out |= {(q, r + 1, i, max(-(1 << 63), min((1 << 63) - 1, -x))) for r, (x, i) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("bits, block", [(3, 16_384), (0, 7), (5, 3)])
def test_top_k_is_exact(spark, bits, block):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(700)]
    rows += [(1000 + i, list(rows[3][1])) for i in range(40)]  # ties
    rows += [(None, [1.0] * 8), (50, None), (100, [1.0] * 7 + [None]), (150, [float("nan")] * 8), (200, [float("inf")] * 8), (2000, []), (2001, []), (2050, [1.0, 2.0]), (2051, [1.0, 2.0])]
    df = spark.createDataFrame([(i, e, 1, 0.5) for i, e in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = vafile.top_k(df, F.col("vec_id") % 50 == 0, cell_bits=bits, query_rows=block).collect()
    assert {tuple(r) for r in got} == brute_top(rows) and len(got) == len(brute_top(rows))


def test_top_k_of_large_numbers_and_of_nothing(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in vafile.top_k(df, F.col("vec_id") % 50 == 0).collect()} == brute_top(rows)
    assert vafile.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold_and_spare_exact_reads():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(0, 0.12, (4000, 32)))
    shift = np.full(4000, 3)
    cells = np.floor(x / 8).astype(np.int8)
    upper, lower = vafile.bounds(x[:20], cells, shift)
    score = x[:20] @ x.T
    assert (lower <= score).all() and (score <= upper).all()
    c = vafile.Candidates(np.arange(20), x[:20], 5)
    c.add(np.arange(4000), np.arange(4000), cells, shift)
    assert c.prune()[0].size < 0.2 * 20 * 4000
    large = np.floor(rng.normal(0, 1e25, (200, 9)))
    s = np.maximum(2, np.frexp(np.abs(large).max(1) / 127)[1])
    upper, lower = vafile.bounds(large[:5], np.floor(large / np.exp2(s)[:, None]).astype(np.int8), s)
    true = np.array([[max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(u, v)))) for v in large] for u in large[:5]], dtype=float)
    assert (lower <= true).all() and (true <= upper).all()


# ---- Jaccard join


def brute_join(rows, width=5):
    sets = [frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []) for w in (words(t) for _, t in rows)]
    n = len(rows)
    links = [[] for _ in rows]
    for a, b in itertools.combinations(range(n), 2):
        both = len(sets[a] & sets[b])
        if both and rows[a][0] is not None and rows[b][0] is not None and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            links[a].append(b), links[b].append(a)
    label = list(range(n))
    for start in range(n):
        seen, todo = {start}, [start]
        while todo:
            for y in links[todo.pop()]:
                if y not in seen:
                    seen.add(y), todo.append(y)
        label[start] = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
    return sorted((rows[i][0] if rows[i][0] is not None else -1, len(sets[i]), len(links[i]), label[i] if label[i] is not None else -1) for i in range(n))


def corpus(seed=4):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = list(rng.choice(vocabulary, 60))
    rows = []
    for i in range(120):
        w = list(rng.choice(vocabulary, int(rng.choice([1, 3, 4, 5, 6, 8, 9, 12, 20, 40, 90, 200]))))
        if i % 5 == 0:
            w = passage + w
        rows.append((len(rows), " ".join(w)))
        for _ in range(int(rng.integers(0, 4))):
            v = list(w)
            for _ in range(int(rng.integers(0, 1 + len(v) // 20))):
                v[int(rng.integers(0, len(v)))] = "changed" + str(rng.integers(0, 9))
            if rng.random() < 0.3:
                v.append("more")
            rows.append((len(rows), " ".join(v).upper() if rng.random() < 0.2 else " \t".join(v)))
    rows += [(5000 + i, "one two three four five six seven eight nine ten") for i in range(60)]  # a group of copies
    rows += [(6000, None), (6001, ""), (6002, " \n "), (None, rows[0][1]), (7, rows[7][1]), (6003, "lorem ipsum " * 20_000)]
    return rows


@pytest.mark.parametrize("local", [500_000, 0])
def test_join_loses_no_link(spark, monkeypatch, local):
    monkeypatch.setattr(jaccard, "connected_components", lambda e: connected_components(e, local))
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, cls int, part string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.n_similar, r.component_id if r.component_id is not None else -1) for r in jaccard.join(df).collect())
    assert got == brute_join(rows)


@pytest.mark.parametrize("common, sharing", [(4, 0.5), (10**9, 1e-9), (50, 0.05)])
def test_join_holds_for_any_allocation(spark, monkeypatch, common, sharing):
    """Many deletions, no common shingles, blocks of components."""
    monkeypatch.setattr(jaccard, "COMMON_SHARE", common)
    monkeypatch.setattr(jaccard, "SHARING", sharing)
    monkeypatch.setattr(jaccard, "COMPONENT_BYTES", 4096)
    monkeypatch.setattr(jaccard, "HOT_SHARE", 100)
    rows = corpus(9)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.n_similar, r.component_id if r.component_id is not None else -1) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_join(rows)


def test_schemes_find_every_similar_pair():
    rng = np.random.default_rng(8)
    for n in (4, 5, 7, 10, 16, 33, 80, 250):
        first = [s for s in jaccard.bands(n, 80, 100) if s <= n][-1]
        k = jaccard.bands(n, 80, 100).index(first)
        d = jaccard.difference(first, 80, 100)
        plans = [jaccard.allocate(first, docs, 80, 100) for docs in (10, 10**4, 10**9)] + [((d + 2) // 2, (d + 2) // 2, 0), (d + 3, 0, 2), (d + 3, 2, 2)]
        for _ in range(60):
            r = rng.integers(0, 1 << 63, n).astype(np.uint64)
            gone = int(rng.integers(0, d + 1))
            s = np.concatenate([r[: n - gone // 2], rng.integers(0, 1 << 63, gone - gone // 2).astype(np.uint64)])
            both = n - gone // 2
            if 100 * both < 80 * (len(r) + len(s) - both) or len(s) < n:
                continue
            often = rng.random(n + gone) < rng.choice([0, 0.3, 0.9, 1])
            rare_of = {int(h): bool(c) for h, c in zip(np.concatenate([r, s[both:]]), often)}
            flags = [np.array([rare_of[int(h)] for h in x]) for x in (r, s)]
            for m, b, spare in plans:
                assert len(np.intersect1d(jaccard.keys_of(r, flags[0], k, first, d, m, b, spare), jaccard.keys_of(s, flags[1], k, first, d, m, b, spare)))


def test_unlike_sets_share_no_key():
    """Random sets, some of few rare shingles, in the scheme of a million."""
    rng = np.random.default_rng(9)
    for n in (10, 14, 30, 80, 300, 1000):
        k = [i for i, first in enumerate(jaccard.bands(5000, 80, 100)) if first <= n][-1]
        first = jaccard.bands(5000, 80, 100)[k]
        d = jaccard.difference(first, 80, 100)
        scheme, seen, keys = jaccard.allocate(first, 10**6, 80, 100), Counter(), 0
        for i in range(1000 if n < 200 else 200):
            s = rng.integers(0, 1 << 63, n).astype(np.uint64)
            found = np.unique(jaccard.keys_of(s, rng.random(n) < (0.7 if i % 2 else 0), k, first, d, *scheme))
            seen.update(found.tolist())
            keys += len(found)
        assert max(seen.values()) == 1 and keys < 6 * n * (1000 if n < 200 else 200)


def test_large_groups_are_compared_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 5)
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(80)]
    rows = [(i, " ".join([*passage, *(f"x{i}{j}" for j in range(int(rng.integers(1, 25))))])) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in jaccard.join(df).collect())
    assert got == brute_join(rows) and max(r[2] for r in got) > 20


def test_join_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(none).count() == 0
    got = jaccard.join(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 1), (2, 0, 0, 2)]


@pytest.mark.parametrize("local", [500_000, 0])
def test_components(spark, local):
    edges = [(1, 2), (2, 3), (3, 9), (10, 11), (11, 10), (7, 7), *((i, i + 1) for i in range(20, 40))]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), local).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 9)}, 10: 10, 11: 10, 7: 7, **{i: 20 for i in range(20, 41)}}
    assert connected_components(spark.createDataFrame([], "a long, b long"), local).count() == 0


# ---- chat


def brute_cost(roles, costs):
    table = chat.steps(costs)
    best = {chat.START: 0}
    for r in roles:  # all ways, without remembering more than the states
        new = {}
        for s, v in best.items():
            for q in range(1, 4):
                x = v + table[chat.code(r)][s][q][0]
                if x < chat.NEVER:
                    new[q] = min(x, new.get(q, chat.NEVER))
        best = new
    return min(v + chat.ending(s, costs)[0] for s, v in best.items()) // chat.ONE


def paid(rows, costs):
    total = 0
    for r in rows:
        total += costs.insert if r.action == "insert" else 0
        total += (costs.adopt if chat.code(r.role) == chat.OTHER else costs.relabel) if r.action.startswith("relabel") else 0
        total += costs.merge if r.action.endswith("merge") else 0
    return total


def test_repairs_are_legal_and_cheapest(spark):
    rng = np.random.default_rng(6)
    kinds = ["user", "assistant", "system", None, "tool", " Human ", "bot"]
    rows = [(c, t, kinds[int(rng.integers(0, 7))], f"t{c}.{t} <|im_end|>") for c in range(60) for t in range(int(rng.integers(1, 9)))]
    rows += [(None, 0, "assistant", None), (None, None, "user", "late"), (77, 1, "user", "same"), (77, 1, "user", "same")]
    rows += [(99, t, kinds[int(rng.integers(0, 4))], "hot") for t in range(3000)]  # one conversation over many partitions
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, seq int, action string")
    for costs in (chat.Costs(), chat.Costs(final=(chat.ASSISTANT,)), chat.Costs(merge=9, insert=1)):
        got = chat.format_turns(df, costs).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sum(r.action != "insert" for r in got) == len(rows)
        by = {}
        for r in sorted(got, key=lambda r: r.seq):
            by.setdefault(r.conv_id, []).append(r)
        for c, turns in by.items():
            own = [r for r in turns if r.action != "insert"]
            assert paid(turns, costs) == brute_cost([r.role for r in own], costs)
            text = "".join(r.rendered for r in turns)
            roles = re.findall(r"<\|im_start\|>(\w+)\n", text)
            assert text.count("<|im_end|>\n") == len(roles) == turns[-1].part + 1 == len({r.part for r in turns})
            legal = [chat.START, *(chat.ROLES.index(r) for r in roles)]
            assert all(p in chat.LEGAL for p in zip(legal, legal[1:])) and legal[-1] in costs.final
    assert chat.format_turns(df.limit(0)).count() == 0


# ---- language model


def test_language_model_counts_like_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"W{i}" for i in range(60)]
    rows = []
    for i in range(200):
        w, out = int(rng.integers(0, 60)), []
        for _ in range(int(rng.integers(0, 40))):
            out.append(vocabulary[w])
            w = (w * 7 + int(rng.integers(0, 3))) % 60  # a word says much about the next
        rows.append((i, " ".join(out)))
    rows += [(500, None), (501, ""), (None, "w1 w2"), (3, rows[3][1]), (502, "w1 w1 " * 20_000), (503, "new é NEW")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, id int")
    got = hpylm.model_scores(df).collect()
    learnt = [words(t) + [None] for i, t in rows if crc32(str(i if i is not None else "").encode()) % 5 != 1]
    c = Counter(itertools.chain(*learnt))
    total, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, len(w) + 1, sum(c[x] > 0 for x in w + [None]), round(sum(math.log10((c[x] + 0.5) / (total + 0.5 * (v + 1))) for x in w + [None]), 4)) for i, w in ((i, words(t)) for i, t in rows))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert {r.train_tokens for r in got} == {total}
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.held_out == (crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 1) for r in got)
    again = hpylm.model_scores(df.repartition(3)).collect()
    assert np.allclose(sorted(r.score for r in got), sorted(r.score for r in again))


def test_language_model_sums_to_one():
    """Over all known words and the unknown one, in a context that was seen and in one that wasn't."""
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(0, 40, 300) * hpylm.CONTEXTS + rng.integers(0, 5, 300))
    counts = rng.integers(1, 90, len(pairs))
    hot = np.full(40, -1)
    words_, contexts = pairs // hpylm.CONTEXTS, pairs % hpylm.CONTEXTS
    v = len(np.unique(words_))
    setup = {"seed": 1, "hot": 0, "base": 1 / (v + 1), "d1": 0.7, "d0": 0.5, "s1": 1.0, "s0": 2.0}
    past = []
    s = hpylm.Sweeps.of(0, hot, pairs, counts)
    for n in range(4):
        s = hpylm.Sweeps.of(0, hot, pairs, counts)
        for k in range(1, len(past) + 1):
            s.sweep(setup, past[:k])
        past.append(hpylm._past(s.sums(setup, past), setup, past))
    p = s.parent(setup, past)
    customers = np.bincount(contexts, counts, hpylm.CONTEXTS)
    unknown = (setup["s0"] + setup["d0"] * past[-1]["root_tables"]) * setup["base"] / (setup["s0"] + past[-1]["root_customers"])
    for context in (0, 3, 99):
        c = np.zeros(40)
        t = np.zeros(40)
        tables = np.ones(len(pairs))
        tables[counts > 1] = s.tables
        at = contexts == context
        c[words_[at]], t[words_[at]] = counts[at], tables[at]
        parent = np.where(np.isin(np.arange(40), words_), p, 0)
        rest = (setup["s1"] + setup["d1"] * past[-1]["contexts"][context]) / (setup["s1"] + customers[context])
        assert math.isclose(((c - setup["d1"] * t) / (setup["s1"] + customers[context]) + rest * parent).sum() + rest * unknown, 1, rel_tol=1e-9)


def test_seating_follows_its_distribution():
    """Tables of three customers by the exact conditional probabilities."""
    d, strength, others, p = 0.5, 1.0, 4, 0.2
    s = {1: (1 - d) * (2 - d), 2: 3 * (1 - d), 3: 1.0}
    weight = {t: s[t] * p**t * math.prod(strength + d * (others + i) for i in range(t)) for t in s}
    got = hpylm.seat(np.full(60_000, 3), np.full(60_000, others), np.full(60_000, p), d, strength, np.random.default_rng(0))
    for t in s:
        assert abs((got == t).mean() - weight[t] / sum(weight.values())) < 0.01
    many = hpylm.seat(np.array([5000, 64, 65]), np.zeros(3), np.full(3, 0.01), d, strength, np.random.default_rng(0))
    assert (many >= 1).all() and (many <= [5000, 64, 65]).all()


def test_scores_match_brute_force(spark, monkeypatch):
    """Every text's score by the definition, token by token, from the tables that were sampled."""
    seen = {}
    real = hpylm._scores
    monkeypatch.setattr(hpylm, "_scores", lambda *x: seen.update(zip(("packed", "setup", "past", "burn_in"), x)) or real(*x))
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(0, 60))) if x < 500)) for i in range(150)] + [(900, "never seen words"), (901, None)]
    got = {r.doc_id: r.score for r in hpylm.model_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    setup, past = seen["setup"], seen["past"]
    part = hpylm.Part([r.asDict() for r in seen["packed"].collect() if r["words"] is not None])
    pairs, counts = part.count()
    state, samples = hpylm.Sweeps.of(0, part.hot, pairs, counts), []
    customers = Counter()
    for pair, c in zip(pairs.tolist(), counts.tolist()):
        customers[pair % hpylm.CONTEXTS] += c
    for n, (parent, tables) in enumerate(state.replay(setup, past)):
        if n >= seen["burn_in"]:
            several = iter(tables.tolist())
            at = {pair: (c, next(several) if c > 1 else 1) for pair, c in zip(pairs.tolist(), counts.tolist())}
            total = Counter()
            for pair, (_, t) in at.items():
                total[pair % hpylm.CONTEXTS] += t
            samples.append((parent.tolist(), at, total))
    number = {w: k for k, w in enumerate(part.words.tolist())}
    d, s = setup["d1"], setup["s1"]
    assert len(samples) == 3
    for i, text in rows:
        score = 0.0
        for _, _, words_, contexts, _ in hpylm.doc_tokens(pa.array([text], pa.string())):
            for w, u in zip((words_ >> np.uint64(24)).tolist(), contexts.tolist()):
                k, p = number[w], 0.0
                for parent, at, total in samples:
                    c, t = at.get(k * hpylm.CONTEXTS + u, (0, 0))
                    p += (c - d * t + (s + d * total[u]) * parent[k]) / (s + customers[u])
                score += math.log10(p / len(samples))
        assert math.isclose(got[i], score, rel_tol=1e-9, abs_tol=1e-9)


def test_language_model_of_nothing(spark):
    assert hpylm.model_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = [i for i in range(50) if crc32(str(i).encode()) % 5 == 1]
    got = hpylm.model_scores(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(3, 0, 0)} and all(abs(r.score) < 1e-9 for r in got)


# ---- pipeline


def test_pipeline_stages_take_effect(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "near duplicates":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            label = {r[0]: r[3] for r in brute_join(rows)}
            assert ids == {i for i, t in rows if label[i] == i or not words(t)}
        if name == "decontamination":
            from gneiss.llm import decontam

            hit = {r.doc_id for r in decontam.find(docs, spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
            assert ids == {r.doc_id for r in docs.collect()} - hit
        if name == "secrets":
            assert len(ids) == docs.count() and not out.where("text rlike 'AKIA[A-Z0-9]{16}'").count()
        docs = out
    mixed = corpus_pipeline.mix_sources(spark, docs, d).collect()
    assert 0 < len(mixed) <= docs.count() <= before and all(0 < r.taken <= 2 * r.size for r in mixed)


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b c d e f", "en", "s", 11)] * 2 + [(2, "a b c d e f", "en", "s", 11), (None, "a b c d e f", "en", "s", 11), (3, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 3), (True, 0)]


def test_other_texts_of_a_repeated_id_stay(spark):
    a, b = "a b c d e f g", "one two three four five six seven"
    docs = spark.createDataFrame([(1, a, "x", 0), (5, a, "x", 0), (5, b, "x", 0), (5, None, "x", 0), (7, b, "x", 0)], "doc_id long, text string, row_number string, n_chars int")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == [(1, a), (5, ""), (5, b)]


@pytest.mark.parametrize("n", range(4))
def test_stages_of_nothing_nulls_and_clashing_columns(spark, n):
    name, stage = corpus_pipeline.STAGES[n]
    d = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxic string, item_id string, cls int, score double, part string"
    rows = [(None, None, None, None, None, "x", "y", 1, 0.5, "z"), (-1, "", "en", "s", 0, "x", "y", 1, 0.5, "z"), (-2, "plain words " * 30_000, "en", "s", 0, "x", "y", 1, 0.5, "z"), (-3, "a few plain words of no harm", None, "s", 5, "x", "y", 1, 0.5, "z")]
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, d)
    assert out.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert stage(spark, docs.limit(0), d).count() == 0
