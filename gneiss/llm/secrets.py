"""Secret scans by a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived (letters folded to lower case): text that
matches must satisfy it. The index is partitioned by document: for each block of rows it holds, for every trigram that a
query names, the posting list of rows that have it. Queries are answered by intersecting and joining posting lists, and
only the candidates are verified with the regular expression itself. Rules without mandatory trigrams scan fully. Nothing
is shuffled: a block's postings are used where its texts lie.

Cases: null and empty texts have no spans; texts are scanned whole, whatever their length; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored (``redact`` keeps them).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import _LOWER, map_arrow, raw_bytes

ANY: tuple = ("any",)
MOST = 48  # strings that a set of exact alternatives may hold before it becomes a query


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the pattern, the group whose length counts and the least such length; base rules first."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        for m in _compiled(self.pattern).finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # A run of fewer than 24 is dropped whole, so asking for 24 at once finds the same spans.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----"),
    # Runs are entered at their beginning only, and never given back: a long run is read once.
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("urlcred", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://[^\s/:@]++:[^\s/@]{3,}+@[A-Za-z0-9.-]+"),
)


_CACHE: dict[str, re.Pattern] = {}


def _compiled(pattern: str) -> re.Pattern:
    """Case folding is of ASCII letters only."""
    if pattern not in _CACHE:
        _CACHE[pattern] = re.compile(pattern, re.ASCII)
    return _CACHE[pattern]


# ---- Boolean trigram queries -------------------------------------------------------------------------------------------


def _and(a: tuple, b: tuple) -> tuple:
    if a == ANY or a == b:
        return b
    return a if b == ANY else ("and", a, b)


def _or(a: tuple, b: tuple) -> tuple:
    if ANY in (a, b):
        return ANY
    return a if a == b else ("or", a, b)


def _of_strings(strings: set[str]) -> tuple:
    """One of the strings occurs: a disjunction of conjunctions of their trigrams."""
    if not strings or min(map(len, strings)) < 3:
        return ANY
    out: tuple | None = None
    for s in sorted(strings):
        q: tuple = ANY
        for i in range(len(s) - 2):
            q = _and(q, ("has", s[i : i + 3]))
        out = q if out is None else _or(out, q)
    return out or ANY


def _fold(c: int) -> str:
    return chr(c + 32 if 65 <= c <= 90 else c)


def _node(op, arg) -> tuple[set[str] | None, tuple]:
    """The strings that a node matches, folded, if they are few, else None; and a query."""
    if op is C.LITERAL:
        return {_fold(arg)}, ANY
    if op is C.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                out.add(_fold(x))
            elif kind is C.RANGE and x[1] - x[0] < MOST:
                out |= {_fold(c) for c in range(x[0], x[1] + 1)}
            else:
                return None, ANY
        return (out, ANY) if len(out) <= 8 else (None, ANY)
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        strings: set[str] | None = set()
        query: tuple | None = None
        for branch in arg[1]:
            s, q = _sequence(branch)
            strings = strings | s if strings is not None and s is not None and len(strings | s) <= MOST else None
            q = _and(q, _of_strings(s)) if s is not None else q
            query = q if query is None else _or(query, q)
        return strings, ANY if strings is not None else (query or ANY)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = arg
        s, q = _sequence(inner)
        if low == 0:
            return ({""} | s, ANY) if high == 1 and s is not None else (None, ANY)
        if s is not None and low == high and len(s) == 1:
            return {next(iter(s)) * low}, ANY
        return None, _and(q, _of_strings(s)) if s is not None else q
    if op is C.AT:
        return {""}, ANY
    return None, ANY


def _sequence(nodes) -> tuple[set[str] | None, tuple]:
    query: tuple = ANY
    now: set[str] = {""}
    exact = True
    for op, arg in nodes:
        s, q = _node(op, arg)
        query = _and(query, q)
        if s is None or len(now) * len(s) > MOST:
            query = _and(query, _of_strings(now))
            exact, now = False, s if s is not None else {""}
        else:
            now = {a + b for a in now for b in s}
    return (now, query) if exact else (None, _and(query, _of_strings(now)))


def trigram_query(pattern: str) -> tuple:
    """A query that every text with a match satisfies; ("any",) if no trigram is mandatory."""
    s, q = _sequence(_parser.parse(pattern, re.ASCII))
    return _and(q, _of_strings(s)) if s is not None else q


def trigrams(query: tuple) -> set[str]:
    """The trigrams that a query names."""
    return {query[1]} if query[0] == "has" else set().union(*(trigrams(q) for q in query[1:] if isinstance(q, tuple)))


# ---- Index and search --------------------------------------------------------------------------------------------------


def postings(texts: pa.Array, names: set[str]) -> dict[str, np.ndarray]:
    """The inverted index of a block: for each trigram named the rows that have it, ascending. One pass over the bytes takes
    up the places where two bytes begin a trigram that is named; the third decides which."""
    out = {t: np.zeros(0, np.int64) for t in names}
    wanted = {int.from_bytes(t.encode(), "big"): t for t in names if len(t.encode()) == 3}
    data, offsets = raw_bytes(texts)
    if len(data) < 3 or not wanted:
        return out
    codes = np.sort(np.fromiter(wanted, np.int32, len(wanted)))
    begins = np.zeros(1 << 16, bool)
    begins[codes >> 8] = True
    low = _LOWER[data]
    pair = (low[:-2].astype(np.uint16) << 8) | low[1:-1]
    at = np.flatnonzero(begins[pair])
    code = (pair[at].astype(np.int32) << 8) | low[at + 2]
    found = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    hit = codes[found] == code
    at, found = at[hit], found[hit]
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + 3 <= offsets[row + 1]  # not over the end of a text
    entries = np.unique(found[inside].astype(np.int64) * len(texts) + row[inside])
    which, row = np.divmod(entries, len(texts))
    for k, rows in zip(np.unique(which).tolist(), np.split(row, np.flatnonzero(np.diff(which)) + 1)):
        out[wanted[int(codes[k])]] = rows
    return out


def answer(query: tuple, index: dict[str, np.ndarray]) -> np.ndarray | None:
    """The candidate rows of a query by its postings; None: all rows."""
    if query == ANY:
        return None
    if query[0] == "has":
        return index[query[1]]
    a = answer(query[1], index)
    if query[0] == "and" and a is not None and not len(a):
        return a
    b = answer(query[2], index)
    if a is None or b is None:
        return (b if a is None else a) if query[0] == "and" else None
    return np.intersect1d(a, b, assume_unique=True) if query[0] == "and" else np.union1d(a, b)


def _scanned(texts: pa.Array, pattern: str) -> np.ndarray:
    """The rows that match; all rows if the pattern has what an automaton can't do."""
    try:
        return np.flatnonzero(pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False))
    except pa.ArrowInvalid:
        return np.arange(len(texts))


def find(texts: pa.Array, rules: tuple[Rule, ...] = RULES) -> dict[int, list[tuple[int, int, int]]]:
    """Of a block of texts without nulls: for each row that has any, (start, number of rule, end), sorted."""
    queries = [trigram_query(r.pattern) for r in rules]
    index = postings(texts, set().union(*map(trigrams, queries)))
    found: dict[int, list[tuple[int, int, int]]] = {}
    for k, (rule, query) in enumerate(zip(rules, queries)):
        rows = answer(query, index)
        if rows is None:  # a full scan; the automaton only names the rows that match
            rows = _scanned(texts, rule.pattern)
        for i, text in zip(rows.tolist(), texts.take(pa.array(rows)).to_pylist()):
            for start, end in rule.spans(text):
                found.setdefault(i, []).append((start, k, end))
    for spans in found.values():
        spans.sort()
    return found


def _texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()).fill_null("")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) the spans found: kind:start:end in code points, by start, then kind as listed,
    joined by commas; counts of the base kinds; and the SHA-256 of the base spans."""
    base = [k for k, r in enumerate(rules) if r.base]

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, found = batch.num_rows, find(_texts(batch), rules)
        counts = np.zeros((len(base), n), np.int64)
        nothing = hashlib.sha256(b"").hexdigest()
        digests, joined = [nothing] * n, [""] * n
        for i, spans in found.items():
            said = [f"{rules[k].kind}:{a}:{b}" for a, k, b in spans]
            joined[i] = ",".join(said)
            digests[i] = hashlib.sha256(",".join(s for s, (_, k, _) in zip(said, spans) if rules[k].base).encode()).hexdigest()
            for _, k, _ in spans:
                if rules[k].base:
                    counts[base.index(k), i] += 1
        columns = [batch.column(0), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(joined, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", *(f"n_{rules[k].kind}" for k in base), "base_sha256", "spans"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names[1:-2]) + ", base_sha256 string, spans string"
    return map_arrow(docs.select("doc_id", "text"), f, schema)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by [kind] (overlapping spans together, by the first's kind) and
    ``n_chars``, if there, counted again for the texts that changed."""
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = find(_texts(batch), rules)
        if not found:
            yield batch
            return
        columns = list(batch.columns)
        texts = columns[at].to_pylist()
        lengths = columns[chars].to_pylist() if chars is not None else []
        for i, spans in found.items():
            out, upto = [], 0
            for start, k, end in spans:
                if start >= upto:
                    out += [texts[i][upto:start], f"[{rules[k].kind}]"]
                upto = max(upto, end)
            texts[i] = "".join(out) + texts[i][upto:]
            if chars is not None:
                lengths[i] = len(texts[i])
        columns[at] = pa.array(texts, columns[at].type)
        if chars is not None:
            columns[chars] = pa.array(lengths, columns[chars].type)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_arrow(docs, f, docs.schema)


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
