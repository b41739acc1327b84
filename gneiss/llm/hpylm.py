"""Language-model scoring with a hierarchical Pitman-Yor model.

Three levels of restaurants: one for each context (the word before, hashed into 65,536 contexts, so the table of contexts
has a fixed size), their shared parent of single words, and a uniform base over all known words and one unknown. Customers
of a context are the corpus's word pairs, tables of the contexts are customers of the parent. The seating is sampled by
Gibbs: in each sweep the tables of every (context, word) are drawn given all others, exactly by generalised Stirling
numbers up to 64 customers and by sequential seating beyond; partitions sweep in parallel on the table counts of the
sweep before. Predictive probabilities are averaged over the sweeps after the burn-in, and a text's score is the sum of
their logarithms.

Tokens are hashed to parts by word (and, for words that are a noticeable share of all tokens, by context too, so no part is
hot), travel packed, and stay written by part: a part holds all pairs of its words, so counting, sweeping and scoring need
no further shuffle of tokens. Sweeps exchange arrays of fixed size; a lost task repeats its sweeps from their seeds.

Cases: a null or empty text is one end token; a null id counts as the empty text in the hold-out rule; texts are read whole;
repeated rows are texts of their own, learnt each; without any training text all scores are those of the uniform base over
the unknown word alone (0); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, hash_words, id_bucket, materialize, mix, pieces, raw_bytes, small_batches, trim, word_bounds

U = np.uint64
CONTEXTS = 1 << 16
CHUNK = 1 << 12
PART_BYTES = 18 << 20  # of packed tokens a part
STIRLING = 64
END = 0x9E3779B97F4A7C15
_WORD_BITS = U(24)  # a word is known by its 40 highest bits, and its part


def doc_tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of runs of texts: first text, end, word hashes with an end token each, context of each, first token of each text."""
    data, offsets = raw_bytes(column)
    for first, end, raw, at in pieces(data, offsets):
        starts, ends, of = word_bounds(raw, at)
        h = hash_words(raw, starts, ends)
        n = end - first
        cut = of + np.arange(n + 1)
        w = np.full(len(h) + n, U(END), np.uint64)
        place = np.ones(len(w), bool)
        place[cut[1:] - 1] = False
        w[place] = h
        before = np.empty_like(w)
        before[1:] = w[:-1]
        before[cut[:-1]] = U(END)
        yield first, end, w, (mix(before + U(1)) & U(CONTEXTS - 1)).astype(np.int64), cut


def part_of(w: np.ndarray, context: np.ndarray, parts: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each token, and its place among the hot words (-1: none)."""
    place = np.full(len(w), -1, np.int64)
    if len(hot):
        at = np.searchsorted(hot, w)
        at[at == len(hot)] = 0
        found = hot[at] == w
        place[found] = at[found]
    key = np.where(place >= 0, mix(w + context.astype(np.uint64)), mix(w))
    return (((key >> U(32)) * U(parts)) >> U(32)).astype(np.int64), place


def _hot(docs: DataFrame, parts: int) -> np.ndarray:
    """Words that hold 1 / (4 parts) of all tokens or more, sorted; at most 8 parts of them.

    A batch reports words with 1 / (8 parts) of its tokens; what it leaves out can't hide more than that share of all."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [w for _, _, w, _, _ in doc_tokens(batch.column(0))]
            all_ = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
            u, n = np.unique(all_, return_counts=True)
            big = n * 8 * parts >= len(all_)
            yield pa.RecordBatch.from_arrays([pa.array(u[big].view(np.int64)), pa.array(n[big])], ["w", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([len(all_)], pa.int64())], ["w", "n"])

    counted = materialize(docs.select("text").mapInArrow(f, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "frequent")
    total = counted.where("w is null").agg(F.sum("n")).first()[0] or 0
    rows = counted.where(F.col("w").isNotNull() & (F.col("n") * 8 * parts >= max(1, total))).toArrow()  # at most 8 parts rows
    return np.sort(rows.column("w").to_numpy().view(np.uint64))


def _tokens(docs: DataFrame, parts: int, hot) -> DataFrame:
    """Packed tokens, a row for each batch of texts and part: places of its texts in the batch, how many tokens of each, and
    the tokens as places in the row's sorted words, and contexts. One row more a batch has the ids of its texts.

    A batch is named by its partition and number, so ``docs`` must give the same rows in the same order when a task is run
    again, as a table or a checkpoint does."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        ws, cs, ds, keys, learns, held, texts = [], [], [], [], [], 0, 0
        for batch in batches:
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            learn = batch.column(2).to_numpy(zero_copy_only=False)
            for first, end, w, c, cut in doc_tokens(batch.column(3)):
                ws.append(w), cs.append(c), ds.append(np.repeat(np.arange(texts, texts + end - first), np.diff(cut)))
                keys.append(key[first:end]), learns.append(learn[first:end])
                held, texts = held + len(w), texts + end - first
                if held > 2_500_000 or texts > 50_000:
                    yield _pack(name, ws, cs, ds, np.concatenate(keys), np.concatenate(learns), parts, hot.value)
                    ws, cs, ds, keys, learns, held, texts = [], [], [], [], [], 0, 0
                    name += 1
        if ws:
            yield _pack(name, ws, cs, ds, np.concatenate(keys), np.concatenate(learns), parts, hot.value)
        trim()

    return docs.select("id", "key", "learn", "text").mapInArrow(f, "part int, batch long, docs binary, learn binary, sizes binary, words binary, hot binary, word binary, context binary")


def _pack(name: int, ws: list, cs: list, ds: list, keys: np.ndarray, learn: np.ndarray, parts: int, hot: np.ndarray) -> pa.RecordBatch:
    w, c, d = np.concatenate(ws), np.concatenate(cs), np.concatenate(ds)
    part, place = part_of(w, c, parts, hot)
    order = np.argsort(part.astype(np.uint16) if parts <= 65_536 else part, kind="stable")
    w, c, d, part, place = w[order], c[order], d[order], part[order], place[order]
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    rows = [(name % parts, name, np.ascontiguousarray(keys).tobytes(), None, None, None, None, None, None)]
    small = np.uint16 if len(keys) <= 65_536 else np.uint32
    for a, b in zip(cut, np.append(cut[1:], len(w))):
        words, first, at = np.unique(w[a:b] >> _WORD_BITS, return_index=True, return_inverse=True)
        docs = np.flatnonzero(np.concatenate([[True], d[a + 1 : b] != d[a : b - 1]]))
        who = d[a:b][docs]
        low = np.ascontiguousarray(words.view(np.uint8).reshape(-1, 8)[:, :5])
        index = at.astype(np.uint16) if len(words) <= 65_536 else at.astype(np.uint32)
        sizes = np.diff(np.append(docs, b - a)).astype(np.uint32)
        rows.append((int(part[a]), name, who.astype(small).tobytes(), np.packbits(learn[who]).tobytes(), sizes.tobytes(), low.tobytes(), place[a:b][first].astype(np.int32).tobytes(), index.tobytes(), c[a:b].astype(np.uint16).tobytes()))
    columns = list(zip(*rows))
    arrays = [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *(pa.array(x, pa.binary()) for x in columns[2:])]
    return pa.RecordBatch.from_arrays(arrays, ["part", "batch", "docs", "learn", "sizes", "words", "hot", "word", "context"])


class Part:
    """All tokens of a part: words by number, their pairs with contexts, and the training counts."""

    def __init__(self, rows: list[dict]):
        raws, hots = [], []
        for r in rows:
            wide = np.zeros((len(r["words"]) // 5, 8), np.uint8)
            wide[:, :5] = np.frombuffer(r["words"], np.uint8).reshape(-1, 5)
            raws.append(wide.view(np.uint64).ravel())
            hots.append(np.frombuffer(r["hot"], np.int32))
        self.words, first, at = np.unique(np.concatenate(raws), return_index=True, return_inverse=True)
        self.hot = np.concatenate(hots)[first].astype(np.int64)
        self.rows = rows
        self.number = np.split(at, np.cumsum([len(x) for x in raws])[:-1])

    def tokens(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the k-th row: pair of each token, its place in the row's texts, whether it is learnt."""
        r = self.rows[k]
        context = np.frombuffer(r["context"], np.uint16).astype(np.int64)
        word = np.frombuffer(r["word"], np.uint16 if len(r["word"]) == 2 * len(context) else np.uint32)
        sizes = np.frombuffer(r["sizes"], np.uint32)
        learn = np.unpackbits(np.frombuffer(r["learn"], np.uint8))[: len(sizes)].astype(bool)
        text = np.repeat(np.arange(len(sizes)), sizes)
        return self.number[k][word] * CONTEXTS + context, text, learn[text]

    def count(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs seen in training, ascending, and how often."""
        keys, counts = [], []
        held = 0
        for k in range(len(self.rows)):
            pair, _, learn = self.tokens(k)
            u, n = np.unique(pair[learn], return_counts=True)
            keys.append(u), counts.append(n)
            held += len(u)
            if held > 1_500_000 and len(keys) > 1:
                keys, counts = ([x] for x in _merge(keys, counts))
                held = 0
        return _merge(keys, counts) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    if not len(k):
        return k, n
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(n, first)


_STIRLING: dict[float, np.ndarray] = {}


def stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for c up to STIRLING."""
    if discount not in _STIRLING:
        s = np.full((STIRLING + 1, STIRLING + 1), -np.inf)
        s[0, 0] = 0.0
        for c in range(STIRLING):
            for t in range(c + 2):
                stay = s[c, t] + math.log(c - discount * t) if 0 < t <= c and c - discount * t > 0 else -np.inf
                new = s[c, t - 1] if t else -np.inf
                s[c + 1, t] = np.logaddexp(stay, new)
        _STIRLING[discount] = s
    return _STIRLING[discount]


def seat(counts: np.ndarray, others: np.ndarray, p: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish with so many customers, given the restaurant's other tables and the parent's probability."""
    t = np.ones(len(counts), np.int64)
    s = stirling(discount)
    for c in np.unique(counts[(counts > 1) & (counts <= STIRLING)]).tolist():
        for part in np.array_split(np.flatnonzero(counts == c), max(1, (counts == c).sum() * c // 4_000_000)):
            ts = np.arange(1, c + 1)
            # p(t) ~ S(c, t) p^t times the product of (strength + discount * (others + i)) over i < t
            rise = np.log(strength + discount * (others[part][:, None] + ts[None, :] - 1))
            x = s[c, 1:][None, : c] + ts * np.log(p[part])[:, None] + np.cumsum(rise, 1)
            x = np.exp(x - x.max(1, keepdims=True))
            x = np.cumsum(x, 1)
            t[part] = 1 + (x < rng.random(len(part))[:, None] * x[:, -1:]).sum(1)
    many = np.flatnonzero(counts > STIRLING)
    if len(many):
        # One customer after another; from the 16th on in runs of a sixteenth of those seated.
        n, tables, goal = np.ones(len(many), np.int64), np.ones(len(many), np.int64), counts[many]
        while (n < goal).any():
            run = np.minimum(np.maximum(1, n // 16), goal - n)
            new = (strength + discount * (others[many] + tables)) * p[many]
            chance = new / (new + np.maximum(n - discount * tables, 1e-9))
            tables = np.minimum(tables + rng.binomial(run, np.clip(chance, 0, 1)), np.maximum(goal, 1))
            n = n + run
        t[many] = np.minimum(tables, goal)
    return t


class Sweeps:
    """The state of a part's restaurants. Pairs seen once sit at one table whatever happens; they are kept as sums."""

    def __init__(self, part: int, hot: np.ndarray, single_words: np.ndarray, single_contexts: np.ndarray, pairs: np.ndarray, counts: np.ndarray):
        self.part, self.hot, self.n_words = part, hot, len(hot)
        self.single_words, self.single_contexts = single_words, single_contexts
        self.word, self.context, self.count = pairs // CONTEXTS, pairs % CONTEXTS, counts
        self.tables = np.ones(len(self.count), np.int64)

    @classmethod
    def of(cls, part: int, hot: np.ndarray, pairs: np.ndarray, counts: np.ndarray) -> Sweeps:
        """From all pairs and their counts."""
        one = counts == 1
        words, contexts = np.bincount(pairs[one] // CONTEXTS, minlength=len(hot)), np.bincount(pairs[one] % CONTEXTS, minlength=CONTEXTS)
        return cls(part, hot, words, contexts, pairs[~one], counts[~one])

    def customers(self) -> np.ndarray:
        """Of the part's words in the parent, as far as this part has them."""
        return self.single_words + np.bincount(self.word, self.tables, self.n_words).astype(np.int64)

    def parent(self, setup: dict, past: list[dict]) -> np.ndarray:
        """Probability of each of the part's words in the parent, by the last sums of ``past``."""
        now, before = past[-1], past[-2] if len(past) > 1 else None
        customers = self.customers()
        is_hot = self.hot >= 0
        customers[is_hot] = now["hot"][self.hot[is_hot]]
        tables = np.zeros(self.n_words, np.int64)
        tables[~is_hot] = parent_tables(customers[~is_hot], setup, before, (len(past) - 1, 1, self.part))
        tables[is_hot] = now["hot_tables"][self.hot[is_hot]]
        top = np.where(customers > 0, customers - setup["d0"] * tables, 0.0)
        return (top + (setup["s0"] + setup["d0"] * now["root_tables"]) * setup["base"]) / (setup["s0"] + now["root_customers"])

    def sweep(self, setup: dict, past: list[dict]) -> np.ndarray:
        """Draws all tables anew, given the last sums; the parent's probabilities by which it did."""
        p = self.parent(setup, past)
        others = np.maximum(past[-1]["contexts"][self.context] - self.tables, 0)
        rng = np.random.default_rng((setup["seed"], len(past), 0, self.part))
        self.tables = seat(self.count, others, p[self.word], setup["d1"], setup["s1"], rng)
        return p

    def sums(self, setup: dict, past: list[dict]) -> np.ndarray:
        """Tables by context, customers of the hot words, customers and tables of the other words in the parent."""
        customers = self.customers()
        is_hot = self.hot >= 0
        out = np.zeros(CONTEXTS + setup["hot"] + 2, np.int64)
        out[:CONTEXTS] = self.single_contexts + np.bincount(self.context, self.tables, CONTEXTS).astype(np.int64)
        np.add.at(out, CONTEXTS + self.hot[is_hot], customers[is_hot])
        rest = customers[~is_hot]
        out[-2] = rest.sum()
        out[-1] = parent_tables(rest, setup, past[-1] if past else None, (len(past), 1, self.part)).sum()
        return out

    def replay(self, setup: dict, past: list[dict]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The sweeps whose sums are known: the parent's probabilities after each, and the tables."""
        for n in range(1, len(past)):
            self.sweep(setup, past[:n])
            yield self.parent(setup, past[: n + 1]), self.tables


def parent_tables(customers: np.ndarray, setup: dict, before: dict | None, seed: tuple) -> np.ndarray:
    """Tables of words with so many customers in the parent, given its other tables as they were before."""
    rest = max(0, (before["root_tables"] if before else 0) - 1)
    tables = np.zeros(len(customers), np.int64)
    at = np.flatnonzero(customers > 0)
    if len(at):
        rng = np.random.default_rng((setup["seed"], *seed))
        tables[at] = seat(customers[at], np.full(len(at), rest), np.full(len(at), setup["base"]), setup["d0"], setup["s0"], rng)
    return tables


def _arrays(totals: DataFrame, size: int) -> np.ndarray:
    """The sum of arrays that parts sent in chunks of CHUNK; as large as ``size`` whatever the input."""
    out = np.zeros(size, np.int64)
    for row in totals.groupBy("at").applyInPandas(_add, "at int, sums binary").collect():
        a = np.frombuffer(row["sums"], np.int64)
        out[row["at"] * CHUNK : row["at"] * CHUNK + len(a)] = a
    return out


def _add(pdf):
    total = sum(np.frombuffer(x, np.int64) for x in pdf["sums"])
    return pdf.head(1).assign(sums=[total.tobytes()])


def _chunks(x: np.ndarray) -> pa.RecordBatch:
    at = [i for i in range(0, len(x), CHUNK) if x[i : i + CHUNK].any()]
    return pa.RecordBatch.from_arrays([pa.array([i // CHUNK for i in at], pa.int32()), pa.array([x[i : i + CHUNK].tobytes() for i in at], pa.binary())], ["at", "sums"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """A partition's rows by part; they come sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["part"] != row["part"]:
                yield held[0]["part"], held
                held = []
            held.append(row)
    if held:
        yield held[0]["part"], held


def _counts(packed: DataFrame) -> DataFrame:
    """The training counts of each part; pairs seen once, the most by far, only as sums."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _parts(batches):
            rows = [r for r in rows if r["words"] is not None]
            if rows:
                p = Part(rows)
                s = Sweeps.of(part, p.hot, *p.count())
                arrays = (s.hot.astype(np.int32), s.single_words.astype(np.int32), s.single_contexts.astype(np.int32), s.word * CONTEXTS + s.context, s.count)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], COUNTED)

    return packed.mapInArrow(f, "part int, hot binary, single_words binary, single_contexts binary, pairs binary, counts binary")


COUNTED = ["part", "hot", "single_words", "single_contexts", "pairs", "counts"]


def _open(row: dict) -> Sweeps:
    hot, words, contexts = (np.frombuffer(row[c], np.int32).astype(np.int64) for c in COUNTED[1:4])
    return Sweeps(row["part"], hot, words, contexts, np.frombuffer(row["pairs"], np.int64), np.frombuffer(row["counts"], np.int64))


def _statistics(counted: DataFrame, n_hot: int) -> np.ndarray:
    """By context the customers, by hot word its count, and: words that aren't hot, tokens, pairs seen once and twice, and
    words with one and two pairs that aren't hot."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = _open(row)
                out = np.zeros(CONTEXTS + n_hot + 6, np.int64)
                out[:CONTEXTS] = s.single_contexts + np.bincount(s.context, s.count, CONTEXTS).astype(np.int64)
                words = s.single_words + np.bincount(s.word, s.count, s.n_words).astype(np.int64)
                kinds = s.single_words + np.bincount(s.word, minlength=s.n_words)
                is_hot = s.hot >= 0
                np.add.at(out, CONTEXTS + s.hot[is_hot], words[is_hot])
                rest = kinds[~is_hot]
                out[-6:] = (words[~is_hot] > 0).sum(), words.sum(), s.single_words.sum(), (s.count == 2).sum(), (rest == 1).sum(), (rest == 2).sum()
                yield _chunks(out)

    return _arrays(counted.mapInArrow(f, "at int, sums binary"), CONTEXTS + n_hot + 6)


def _discount(once: int, twice: int) -> float:
    return float(np.clip(once / max(1, once + 2 * twice), 0.1, 0.95))


def _past(sums: np.ndarray, setup: dict, past: list[dict]) -> dict:
    """What the sums of a sweep say, with the hot words' tables in the parent."""
    hot = sums[CONTEXTS:-2]
    hot_tables = parent_tables(hot, setup, past[-1] if past else None, (len(past), 2, 0))
    return {"contexts": sums[:CONTEXTS], "hot": hot, "hot_tables": hot_tables, "root_customers": int(sums[-2] + hot.sum()), "root_tables": int(sums[-1] + hot_tables.sum())}


def learn(counted: DataFrame, n_hot: int, sweeps: int, seed: int, strengths: tuple[float, float]) -> tuple[dict, list[dict]]:
    """The model's settings and the sums after each sweep."""
    stats = _statistics(counted, n_hot)
    words, tokens, once, twice, alone, pairs = (int(x) for x in stats[-6:])
    hot_counts = stats[CONTEXTS:-6]
    vocabulary = words + int((hot_counts > 0).sum())
    setup = {
        "seed": seed, "hot": n_hot, "base": 1 / (vocabulary + 1), "vocabulary": vocabulary, "tokens": tokens, "hot_counts": hot_counts, "customers": stats[:CONTEXTS],
        "d1": _discount(once, twice), "d0": _discount(alone, pairs), "s1": strengths[1], "s0": strengths[0],
    }
    past: list[dict] = []
    for _ in range(sweeps + 1):
        sent = counted.sparkSession.sparkContext.broadcast((setup, past))

        def f(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            setup, past = sent.value
            for batch in batches:
                for row in batch.to_pylist():
                    s = _open(row)
                    for n in range(1, len(past) + 1):
                        s.sweep(setup, past[:n])
                    yield _chunks(s.sums(setup, past))

        past = [*past, _past(_arrays(counted.mapInArrow(f, "at int, sums binary"), CONTEXTS + n_hot + 2), setup, past)]
    return setup, past


def _scores(packed: DataFrame, setup: dict, past: list[dict], burn_in: int) -> DataFrame:
    """id, key, tokens, known tokens and the sums of the logarithms of each text."""
    sent = packed.sparkSession.sparkContext.broadcast((setup, past))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        setup, past = sent.value
        for part, rows in _parts(batches):
            for r in rows:
                if r["words"] is None:
                    yield _partial(r["batch"], r["docs"], None, None)
            rows = [r for r in rows if r["words"] is not None]
            if not rows:
                continue
            p = Part(rows)
            pairs, counts = p.count()
            s = Sweeps.of(part, p.hot, pairs, counts)
            several = np.flatnonzero(counts > 1)
            samples = []
            for n, (parent, tables) in enumerate(s.replay(setup, past)):
                if n >= burn_in:
                    t = np.ones(len(counts), np.int32)
                    t[several] = tables
                    samples.append((parent, t, past[n + 1]["contexts"]))
            seen = np.bincount(pairs // CONTEXTS, counts, len(p.words)).astype(np.int64)
            is_hot = p.hot >= 0
            seen[is_hot] = setup["hot_counts"][p.hot[is_hot]]
            base = np.log10((seen + 0.5) / (setup["tokens"] + 0.5 * (setup["vocabulary"] + 1)))
            for k, row in enumerate(rows):
                pair, text, _ = p.tokens(k)
                u, at = np.unique(pair, return_inverse=True)
                word, context = u // CONTEXTS, u % CONTEXTS
                where = np.searchsorted(pairs, u)
                where[where == len(pairs)] = 0
                there = pairs[where] == u if len(pairs) else np.zeros(len(u), bool)
                c = np.where(there, counts[where], 0) if len(pairs) else np.zeros(len(u))
                total = np.zeros(len(u))
                for parent, tables, contexts in samples:
                    t = np.where(there, tables[where], 0) if len(pairs) else 0
                    total += (c - setup["d1"] * t + (setup["s1"] + setup["d1"] * contexts[context]) * parent[word]) / (setup["s1"] + setup["customers"][context])
                logs = np.log10(total / len(samples))
                n = len(row["sizes"]) // 4
                known = np.bincount(text, (seen[word] > 0)[at], n)
                sums = np.zeros(n, SUMS)
                sums["n"], sums["known"], sums["base"], sums["logs"] = np.bincount(text, minlength=n), known, np.bincount(text, base[word][at], n), np.bincount(text, logs[at], n)
                yield _partial(row["batch"], None, row["docs"], sums.tobytes())
        trim()

    def total(table: pa.Table) -> pa.Table:
        ids = next(x for x in table.column("ids").to_pylist() if x is not None)
        keys = np.frombuffer(ids, np.int64).reshape(-1, 2)
        small = np.uint16 if len(keys) <= 65_536 else np.uint32
        out = {name: np.zeros(len(keys), np.float64 if name in ("base", "logs") else np.int64) for name in SUMS.names}
        for docs, sums in sorted((d, x) for d, x in zip(table.column("docs").to_pylist(), table.column("sums").to_pylist()) if d is not None):
            at, sums = np.frombuffer(docs, small), np.frombuffer(sums, SUMS)
            for name in SUMS.names:
                out[name][at] += sums[name]
        return pa.table({"id": keys[:, 0], "key": keys[:, 1], **out})

    parts = packed.mapInArrow(f, "batch long, ids binary, docs binary, sums binary")
    return parts.groupBy("batch").applyInArrow(total, "id long, key long, n long, known long, base double, logs double")


SUMS = np.dtype([("n", np.uint32), ("known", np.uint32), ("base", np.float64), ("logs", np.float64)])


def _partial(batch: int, ids: bytes | None, docs: bytes | None, sums: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), *(pa.array([x], pa.binary()) for x in (ids, docs, sums))], ["batch", "ids", "docs", "sums"])


def model_scores(docs: DataFrame, folds: int = 5, held_out: int = 1, sweeps: int = 5, burn_in: int = 2, seed: int = 11, strengths: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", "text", (id_bucket(folds) != held_out).alias("learn"))
    # A text is known by its id and the hash of both; rows equal in these share one score.
    rows = rows.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("key", F.xxhash64("doc_id", "text"))
    chars, n = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    guess = ((chars or 0) / 6 + n) * 5  # bytes of packed tokens
    parts = max(1, min(spark.sparkContext.defaultParallelism, math.ceil(guess / (1 << 20))), math.ceil(guess / PART_BYTES))
    hot = _hot(rows, parts)
    packed = checkpoint(_tokens(rows, parts, spark.sparkContext.broadcast(hot)).repartitionById(parts, "part").sortWithinPartitions("part"))
    counted = checkpoint(_counts(packed))
    setup, past = learn(counted, len(hot), sweeps, seed, strengths)
    found = _scores(packed, setup, past, min(burn_in, sweeps - 1))
    found = found.groupBy("id", "key").agg(*(F.sum(c).alias(c) for c in ("n", "known", "base", "logs")))
    each = rows.select("doc_id", "learn", "id", "key")
    times = each.groupBy("id", "key").count().where("count > 1").select("id", "key", F.col("count").alias("times"))
    out = each.join(found, ["id", "key"]).join(times, ["id", "key"], "left")
    k = F.coalesce("times", F.lit(1))
    return out.select(
        "doc_id", (~F.col("learn")).alias("held_out"), (F.col("n") / k).cast("long").alias("n_tokens"), (F.col("known") / k).cast("long").alias("n_known"),
        F.lit(setup["tokens"]).cast("long").alias("train_tokens"), (F.col("base") / k).alias("base_score"), (F.col("logs") / k).alias("score"),
    )


def op9_hpylm(spark, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those outside the held-out fold."""
    return model_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
