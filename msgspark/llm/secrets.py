"""Secret scans: strong patterns, and weak credential parts that are reported only when complementary parts meet in a scope."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, unpacked

#: The kinds in their order, base kinds first.
KINDS = ["assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint"]
BASE = KINDS[:3]

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # AKIA[A-Z0-9]+ of 16 or more: a run holds no longer match than from its first AKIA
HEX = re.compile(r"[0-9a-f]{32,}")  # the maximal runs of 32 or more

#: Weak parts of a credential: nothing on their own.
WEAK_ID = re.compile(r"""\b(?:(?:access|client|account|app|key)[_-]?(?:key)?[_-]?id|user(?:_?name)?|login)\b["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{4,}""", re.ASCII | re.IGNORECASE)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])(?=[0-9A-Z+/_-]*[a-z])[A-Za-z0-9+/_-]{24,}={0,2}")
WEAK_ENDPOINT = re.compile(r"""\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ftp)://[^\s"'<>]+|\b(?:endpoint|host|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z0-9.:-]+""", re.ASCII | re.IGNORECASE)
REACH = 400  # code points between linked parts at most; a blank line between them ends the scope

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak identifiers, secrets and endpoints with their complements in scope: an interval join by sorted starts and ends.

    A weak identifier needs a secret (weak, or a base assignment or hex string); a weak secret needs an identifier (weak, or a base access key); an endpoint needs both. Two parts are in scope if at most `reach` code points and no blank line lie
    between them; parts that overlap are not complements. Of the parts on one side the nearest decides, so a text costs its parts times the logarithm of their number, however long they are. Weak parts that overlap a base span are not reported again.
    """
    strong = lambda *kinds: [(s, e) for k, s, e in base if k in kinds]
    weak_ids = [m.span() for m in WEAK_ID.finditer(text)] if "=" in text or ":" in text else []
    ids = weak_ids + strong("access")
    if not ids:
        return []
    weak_secrets = [m.span() for m in WEAK_SECRET.finditer(text)]
    secrets = weak_secrets + strong("assign", "hex")
    if not secrets:
        return []
    breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    taken = sorted((s, e) for _, s, e in base)
    last = list(accumulate((e for _, e in taken), max))
    sides = {id(parts): (sorted(s for s, _ in parts), sorted(e for _, e in parts)) for parts in (ids, secrets)}

    def near(end: int, start: int) -> bool:
        return start - end <= reach and bisect_left(breaks, end) == bisect_left(breaks, start)

    def meets(span: tuple[int, int], parts: list[tuple[int, int]]) -> bool:
        starts, ends = sides[id(parts)]
        after, before = bisect_left(starts, span[1]), bisect_right(ends, span[0])
        return (after < len(starts) and near(span[1], starts[after])) or (before > 0 and near(ends[before - 1], span[0]))

    def free(span: tuple[int, int]) -> bool:
        i = bisect_left(taken, (span[1], 0))
        return i == 0 or last[i - 1] <= span[0]

    out = [("linked_id", *x) for x in weak_ids if free(x) and meets(x, secrets)]
    out += [("linked_secret", *x) for x in weak_secrets if free(x) and meets(x, ids)]
    out += [("linked_endpoint", *m.span()) for m in WEAK_ENDPOINT.finditer(text) if free(m.span()) and meets(m.span(), ids) and meets(m.span(), secrets)]
    return out


def spans_of(text: str | None, reach: int = REACH) -> list[Span]:
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + linked_spans(text, base, reach), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """docs with `spans` array<struct<kind, start, end>>: code points, end exclusive, by start, then kind in the order of KINDS.

    One pass without a shuffle: every row is judged on its own, so that repeated rows, ties and hot sources need no care. Null and empty texts have no
    spans; very long ones are read whole, in time that follows their length and number of parts. A column named spans in docs is replaced, all others stay whatever their names.
    """

    def compute() -> Callable[[pa.RecordBatch], Iterator[pa.Array]]:
        return lambda batch: iter([pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t, reach)] for t in batch.column(0).to_pylist()], _SPANS)])

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    found = beside(docs.drop("spans"), text, compute, T.ArrayType(span))
    return found.select(*unpacked(found, "spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_report(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (as one string), n_linked; a row for every row of docs, repeated ones too. Null and empty texts have no spans, and the digest of nothing; texts of any length are read whole; other columns are ignored."""
    found = find_secrets(docs.select(F.col(row_id).alias("doc_id"), F.col(text).alias("text"))).drop("text")
    n = lambda *kinds: F.size(F.filter("spans", lambda x: x["kind"].isin(*kinds))).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), n(*KINDS[3:]).alias("n_linked"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by `mark` (overlapping spans by one); texts without spans, null texts and all other columns unchanged.

    Every row is masked on its own: repeated rows and ids stay repeated, no rows give no rows, a very long text is held whole.
    """

    def masked(t: str | None) -> str | None:
        parts, end = [], 0
        for _, start, stop in spans_of(t):
            if start >= end:
                parts += [t[end:start], mark]
            end = max(end, stop)
        return "".join(parts) + t[end:] if parts else t

    def compute() -> Callable[[pa.RecordBatch], Iterator[pa.Array]]:
        return lambda batch: iter([pa.array([masked(t) for t in batch.column(0).to_pylist()], batch.schema.field(0).type)])

    found = beside(docs, text, compute, docs.schema[text].dataType)
    return found.select(*unpacked(found, text))
