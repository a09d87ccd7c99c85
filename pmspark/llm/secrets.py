"""Secret scans over a trigram inverted index.

Each rule is a regular expression. From its syntax tree follows a Boolean query over trigrams that every
match must hold; a rule without any mandatory trigram scans all texts. The tasks read their texts in
steps of about a megabyte: each step gets an index from trigram to the texts that hold it, the queries
intersect and unite its postings, and only the candidates are run through the expressions. Trigrams are
of bytes with A to Z folded, so one index serves rules of either case. Nothing is shuffled, and a step's
index is as small as the step, whatever the table's size or skew; a lost executor's steps are redone.

Defined results: a null text is an empty one and has no spans; repeated rows each give their row; null
ids are kept; an empty table gives no rows; other columns are ignored. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as syntax

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, steps, table


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (ASCII only), left to right without overlap, whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


#: Fixed values of the contract.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Further kinds, of widely documented token formats.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("login", r"[a-z][a-z0-9+]*://[A-Za-z0-9._%-]+:[A-Za-z0-9._%+!-]+@[A-Za-z0-9.-]+"),
)
RULES = BASE + MORE

# A query is True (holds everywhere), a trigram as bytes, or ("and" | "or", frozenset of queries).
#: Sets of strings larger than this are no longer followed exactly.
MOST_STRINGS = 24


def both(kind: str, parts: Iterable):
    """The conjunction or disjunction of queries, simplified."""
    parts = set(parts)
    if kind == "or" and True in parts:
        return True
    parts.discard(True)
    flat = set()
    for p in parts:
        flat |= p[1] if isinstance(p, tuple) and p[0] == kind else {p}
    if not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def held(strings: Iterable[bytes]):
    """The query of "one of these strings occurs"."""
    return both("or", (both("and", (s[i : i + 3] for i in range(len(s) - 2))) for s in strings))


@dataclass(frozen=True)
class Known:
    """What is known of an expression's matches: all of them (``exact``), or how they begin and end, and a query."""

    exact: frozenset | None
    begins: frozenset
    ends: frozenset
    query: object

    @staticmethod
    def of(strings: Iterable[bytes]) -> Known:
        s = frozenset(strings)
        return Known(s, s, s, True) if len(s) <= MOST_STRINGS else ANY

    def whole(self):
        return both("and", [self.query, held(self.exact) if self.exact is not None else both("and", [held(self.begins), held(self.ends)])])


_NONE = frozenset([b""])
ANY = Known(None, _NONE, _NONE, True)


def _trim(strings: Iterable[bytes], keep) -> frozenset:
    out = frozenset(strings)
    for n in (2, 1):
        if len(out) > MOST_STRINGS:
            out = frozenset(keep(s, n) for s in out)
    return out if len(out) <= MOST_STRINGS else _NONE


def _joined(a: Known, b: Known) -> Known:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return Known.of(x + y for x in a.exact for y in b.exact)
    query = both("and", [a.query, b.query] + [held(x.exact) for x in (a, b) if x.exact is not None])
    query = both("and", [query, held(x[-2:] + y[:2] for x in a.ends for y in b.begins)])
    begins = {x + y for x in a.exact for y in b.begins} if a.exact is not None else a.begins
    ends = {x + y for x in a.ends for y in b.exact} if b.exact is not None else b.ends
    query = both("and", [query, held(begins), held(ends)])
    return Known(None, _trim(begins, lambda s, n: s[:n]), _trim(ends, lambda s, n: s[-n:]), query)


def _either(parts: list[Known]) -> Known:
    if all(p.exact is not None for p in parts) and len(exact := frozenset().union(*(p.exact for p in parts))) <= MOST_STRINGS:
        return Known.of(exact)
    query = both("or", [p.whole() for p in parts])
    return Known(None, _trim(frozenset().union(*(p.begins for p in parts)), lambda s, n: s[:n]), _trim(frozenset().union(*(p.ends for p in parts)), lambda s, n: s[-n:]), query)


def _char(code: int) -> bytes:
    return chr(code).encode().lower()


def _known(tree) -> Known:
    out = Known.of([b""])
    for op, arg in tree:
        if op is C.LITERAL:
            one = Known.of([_char(arg)])
        elif op is C.IN:
            chars: set | None = set()
            for kind, x in arg:
                if kind is C.LITERAL:
                    chars.add(_char(x))
                elif kind is C.RANGE and x[1] - x[0] < 200:
                    chars |= {_char(c) for c in range(x[0], x[1] + 1)}
                else:
                    chars = None
                    break
            one = Known.of(chars) if chars else ANY
        elif op is C.SUBPATTERN:
            one = _known(arg[-1])
        elif op is C.BRANCH:
            one = _either([_known(x) for x in arg[1]])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, inner = arg
            part = _known(inner)
            if (least, most) == (0, 1):
                one = _either([part, Known.of([b""])])
            elif not least:
                one = ANY
            else:
                one = part
                for _ in range(min(least, 12) - 1):
                    one = _joined(one, part)
                if most != min(least, 12):
                    one = Known(None, one.begins, one.ends, one.whole())
        elif op is C.AT:
            continue
        else:
            one = ANY
        out = _joined(out, one)
    return out


def trigram_query(pattern: str):
    """True if matches need hold no trigram, else a query over byte trigrams with A to Z folded."""
    return _known(syntax.parse(pattern)).whole()


def trigrams_of(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


class Index:
    """Postings of the wanted trigrams over one step of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray, pairs: np.ndarray):
        self.rows = np.arange(len(offsets) - 1)
        self.wanted, low = wanted, LOWER[data]
        two = low[:-2].astype(np.uint32) | low[1:-1].astype(np.uint32) << 8 if len(low) > 2 else np.zeros(0, np.uint32)
        at = np.flatnonzero(pairs[two])
        code = two[at] | low[at + 2].astype(np.uint32) << 16
        place = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
        row = np.searchsorted(offsets, at, "right") - 1
        good = (wanted[place] == code) & (at + 3 <= offsets[row + 1])
        keys = np.unique(place[good] * len(self.rows) + row[good])
        self.ids, self.docs = np.divmod(keys, max(len(self.rows), 1))

    def postings(self, trigram: bytes) -> np.ndarray:
        k = np.searchsorted(self.wanted, int.from_bytes(trigram, "little"))
        return self.docs[slice(*np.searchsorted(self.ids, [k, k + 1]))]

    def rows_of(self, query) -> np.ndarray:
        """Sorted rows where the query holds."""
        if query is True:
            return self.rows
        if isinstance(query, bytes):
            return self.postings(query)
        found = sorted(map(self.rows_of, query[1]), key=len)
        for x in found[1:]:
            found[0] = np.intersect1d(found[0], x, True) if query[0] == "and" else np.union1d(found[0], x)
        return found[0]


def scan_texts(texts: pa.Array, rules=RULES) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(row, [(start, kind's place among the rules, end)] sorted) of the rows with secrets."""
    queries = [trigram_query(r.pattern) for r in rules]
    compiled = [re.compile(r.pattern.encode()) for r in rules]
    wanted = np.array(sorted({int.from_bytes(t, "little") for q in queries for t in trigrams_of(q)} | {0}), dtype=np.uint32)
    pairs = np.zeros(1 << 16, dtype=bool)
    pairs[wanted & 0xFFFF] = True
    for first, _, data, offsets in steps(texts):
        index, raw, found = Index(data, offsets, wanted, pairs), data.tobytes(), {}
        for k, (rule, query, pattern) in enumerate(zip(rules, queries, compiled, strict=True)):
            for row in index.rows_of(query).tolist():
                for m in pattern.finditer(raw[offsets[row] : offsets[row + 1]]):
                    if len(m[rule.group]) >= rule.least:
                        found.setdefault(row, []).append((m.start(), k, m.end()))
        for row, hits in sorted(found.items()):
            begins = np.cumsum((data[offsets[row] : offsets[row + 1]] & 0xC0) != 0x80)  # code points up to each byte
            points = lambda at, b=begins: int(b[at - 1]) if at else 0
            yield first + row, [(points(s), k, points(e)) for s, k, e in sorted(hits)]


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id and spans, an array<struct<start, kind, stop>> by start, then kind as listed among the rules."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("stop", pa.int64())]))
        for batch in batches:
            spans = [[] for _ in range(batch.num_rows)]
            for row, hits in scan_texts(batch.column(1), rules):
                spans[row] = [{"start": s, "kind": rules[k].kind, "stop": e} for s, k, e in hits]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {id_type}, spans array<struct<start:bigint,kind:string,stop:bigint>>")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    names = [r.kind for r in BASE]
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in names),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(names))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    quoted = lambda s: s.replace("'", "''")
    kinds = ",\n".join(f"({k}, '{r.kind}', {r.least})" for k, r in enumerate(RULES))
    parts = " UNION ALL ".join(
        f"SELECT id, {k} AS k, string_split_regex(t, '{quoted(r.pattern)}') AS gaps, regexp_extract_all(t, '{quoted(r.pattern)}') AS hits, regexp_extract_all(t, '{quoted(r.pattern)}', {r.group}) AS kept FROM d"
        for k, r in enumerate(RULES)
    )
    return f"""
WITH kinds(k, kind, least) AS (VALUES {kinds}),
d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({parts}),
i AS (SELECT id, k, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, kept FROM m WHERE len(hits) > 0),
u AS (SELECT id, k, i, length(gaps[i]) AS gap, length(hits[i]) AS n, length(kept[i]) AS kn FROM i),
s AS (SELECT *, sum(gap + n) OVER (PARTITION BY id, k ORDER BY i) AS stop FROM u),
f AS (SELECT id, s.k, kind, kind || ':' || CAST(stop - n AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span, stop - n AS start FROM s JOIN kinds USING (k) WHERE kn >= least),
a AS (SELECT id, string_agg(span, ',' ORDER BY start, k) AS spans, string_agg(span, ',' ORDER BY start, k) FILTER (k < 3) AS base,
  count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex FROM f GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (id)"""


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLES = {"op1_secret_scan": _oracle()}
