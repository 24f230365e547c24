"""Secret scans: plain credential patterns, and multipart credentials linked by an interval join."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.llm.blocks import slices
from cashtide.llm.common import text_of

_I = re.ASCII | re.IGNORECASE
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, so the same as all runs of which the short ones are dropped
#: Kinds found by themselves, in the order in which spans that start together are listed.
BASE_KINDS = ("assign", "access", "hex")

# Parts of credentials that mean little alone.
_WEAK = {
    "ident": re.compile(r"""(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", _I),
    "key": re.compile(r"(?<![A-Za-z0-9+/=_.-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{20,}={0,2}(?![A-Za-z0-9+/=_.-])"),
    "endpoint": re.compile(r"""(?<![a-z0-9])(?:https?|ftps?|ssh|jdbc|mysql|postgres(?:ql)?|mongodb|redis|amqp|s3)://[^\s"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])""", _I),
}
WEAK_KINDS = tuple(_WEAK)
_ALL = BASE_KINDS + WEAK_KINDS
#: What part of a credential each kind can be.
_PART = {"assign": "secret", "access": "ident", "hex": "secret", "ident": "ident", "key": "secret", "endpoint": "endpoint"}

Span = tuple[str, int, int]

_HINT = re.compile("passw|secret|token|api", _I)
#: What every identifier or endpoint has in it.
_OTHER = re.compile("user|login|account|client|access|://|[0-9][.][0-9]", _I)


def base_spans(text: str) -> list[Span]:
    """The spans of the three plain patterns, in code points, by start and then kind."""
    found: list[Span] = []
    if _HINT.search(text):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], _ALL.index(s[0]), s[2]))


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that may be part of a credential, without those that overlap a plain one.

    None in a text without an identifier or an endpoint, as then none of them can be linked.
    """
    if not any(k == "access" for k, _, _ in base) and not _OTHER.search(text):
        return []
    found = sorted((m.start(), m.end(), kind) for kind, pattern in _WEAK.items() for m in pattern.finditer(text))
    merged: list[list[int]] = []  # plain spans as disjoint intervals, so that starts and ends both ascend
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]
    out = []
    for a, b, kind in found:
        i = bisect.bisect_left(starts, b) - 1
        if i < 0 or merged[i][1] <= a:
            out.append((kind, a, b))
    return out


def linked(base: list[Span], weak: list[Span], breaks: list[int], reach: int | None = None) -> list[Span]:
    """The weak spans beside which a complementary part stands.

    An interval join by parts within scopes, which are paragraphs of any length; with ``reach``, only
    of parts that many code points apart at most. A weak secret needs an identifier or an endpoint
    in its interval, a weak identifier or endpoint needs a secret. Spans of a part are swept in
    order, so the join costs a search per weak span and forms no pairs.
    """
    of: dict[str, list[tuple[int, int]]] = {"ident": [], "secret": [], "endpoint": []}
    for kind, a, b in [*base, *weak]:
        of[_PART[kind]].append((a, b))
    index = {}
    last = 1 + max((b for _, _, b in [*base, *weak]), default=0)
    for part, spans in of.items():
        spans.sort()
        ends, high = [], 0
        for _, b in spans:
            ends.append(high := max(high, b))
        index[part] = ([a for a, _ in spans], ends)

    def near(part: str, a: int, b: int) -> bool:
        scope = bisect.bisect_right(breaks, a)
        low = breaks[scope - 1] if scope else 0
        high = breaks[scope] if scope < len(breaks) else last
        if reach is not None:
            low, high = max(a - reach, low), min(b + reach, high)
        starts, ends = index[part]
        i = bisect.bisect_left(starts, high) - 1  # of those that start in time, the one that ends last
        return i >= 0 and ends[i] > low

    needs = {"ident": ("secret",), "secret": ("ident", "endpoint"), "endpoint": ("secret",)}
    return [(k, a, b) for k, a, b in weak if any(near(p, a, b) for p in needs[_PART[k]])]


def scan_text(text: str, reach: int | None = None) -> tuple[list[Span], list[Span]]:
    """The plain spans of a text, and the weak ones that complement each other."""
    base = base_spans(text)
    weak = weak_spans(text, base)
    if weak:
        weak = linked(base, weak, [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)], reach)
    return base, weak


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], _ALL.index(s[0]), s[2])))


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, kinds, starts, ends of all spans, and n_base of them plain.

    Whole texts are read, each in the task that reads its row: the scopes of the interval join are
    paragraphs, so no part ever needs another row and nothing is shuffled. A null text is empty and
    has no spans; rows that repeat an id are scanned each. Other columns are not read. An empty
    table gives no rows. Plain spans are listed first, then weak ones, both by start and kind.
    """
    fields = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t"))
    schema = f"doc_id {fields.schema['doc_id'].dataType.simpleString()}, kinds array<string>, starts array<int>, ends array<int>, n_base int"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, starts, ends, n = [], [], [], []
            for t in batch.column("t"):
                base, weak = scan_text(t.as_py(), reach)
                both = base + weak
                kinds.append([s[0] for s in both])
                starts.append([s[1] for s in both])
                ends.append([s[2] for s in both])
                n.append(len(base))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(kinds, pa.list_(pa.string())),
                    pa.array(starts, pa.list_(pa.int32())),
                    pa.array(ends, pa.list_(pa.int32())),
                    pa.array(n, pa.int32()),
                ],
                names=["doc_id", "kinds", "starts", "ends", "n_base"],
            )

    return fields.mapInArrow(scan, schema)


def span_digest(found: DataFrame) -> DataFrame:
    """The spans of ``secret_scan`` as counts, a hash of the plain ones, and one line of all."""
    order = F.array(*map(F.lit, _ALL))
    zipped = F.arrays_zip("kinds", "starts", "ends")

    def line(spans):
        keyed = F.transform(spans, lambda s: F.struct(s["starts"], F.array_position(order, s["kinds"]), s["ends"], s["kinds"]))
        return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string"))), ",")

    base = F.slice(zipped, F.lit(1), F.col("n_base"))

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kinds"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(zipped).alias("spans")
    )


def digest_of(spans: list[Span]) -> str:
    """What ``span_digest`` gives for plain spans, in plain Python."""
    return hashlib.sha256(listed(spans).encode()).hexdigest()


def redact(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """``text`` with each span, overlapping ones together, replaced by ``mark``."""
    out, at, end = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= end:
            out += [text[at:a], mark]
        at = end = max(end, b)
    return "".join(out) + text[at:]


def without_secrets(docs: DataFrame, text: str = "text", length: str | None = None, reach: int | None = None) -> DataFrame:
    """All rows of ``docs`` with every span replaced in ``text``, and ``length``, if named, set to the new length.

    A null text stays null. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                found.append(t if t is None else redact(t, sum(scan_text(t, reach), [])))
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(found, batch.schema.field(at).type))

    redacted = docs.mapInArrow(run, docs.schema)
    if length is None:
        return redacted
    return redacted.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
