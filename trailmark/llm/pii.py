"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm._arrow import map_texts

#: Kinds in the order that breaks ties of equal starts; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No earlier start inside a run of digits can match when the run's first digit doesn't, so only that one is tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Score of a confirmed span before its context is read.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8}
#: Words that speak for a kind or against it when they stand near a span.
FOR = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|login|client)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|debit|visa|mastercard|amex|payment|pay)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|contact)\b", re.I),
    "iban": re.compile(r"\b(?:iban|bank|account|konto|transfer)\b", re.I),
}
AGAINST = re.compile(r"\b(?:version|release|section|isbn|order|invoice|example|sample|test)\b", re.I)
RAISE, LOWER = 0.2, 0.25


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number (capitals and digits, no spaces) leaves 1 when divided by 97."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # Anchored at each @: the leftmost match starts where the run before it starts, but not inside the match before.
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield m.span()


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        if 15 <= len(bare := m[0].replace(" ", "")) <= 34 and mod97(bare):
            yield m.span()


_FIND = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans}


def spans_of(text: str, window: int = 40) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of one text, by start and then kind; offsets are code points, ends exclusive."""
    found = [(start, k, end) for k, kind in enumerate(KINDS) for start, end in _FIND[kind](text)]
    found.sort()
    out = []
    for start, k, end in found:
        near = text[max(0, start - window) : start] + " " + text[end : end + window]
        score = PRIOR[KINDS[k]] + RAISE * bool(FOR[KINDS[k]].search(near)) - LOWER * bool(AGAINST.search(near))
        out.append((KINDS[k], start, end, round(min(1.0, max(0.0, score)), 4)))
    return out


SPAN = "struct<kind:string,start:bigint,end:bigint,score:double,match:string>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 40) -> DataFrame:
    """Personal data in every whole text.

    Returns one row per input row: `id_col` and `spans`, an array of (kind, start, end, score, match) ordered by
    start and then kind. Kinds email, ip, card (Luhn) and phone are the base; iban (mod-97) is added. `window` is
    the number of code points on each side that are searched for context words; these change the score only.
    Null and empty texts have no spans; repeated rows are answered row by row; other columns are not read.
    Map-only: no shuffle, and memory is bounded by one slice of texts.
    """
    out_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("match", pa.string())]))

    def step(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        rows = [[{"kind": k, "start": s, "end": e, "score": v, "match": t[s:e]} for k, s, e, v in spans_of(t, window)] for t in texts.to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, out_type)], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(frame, "text", f"id {kind}, spans array<{SPAN}>", step).withColumnRenamed("id", id_col)


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """Every input row with spans of at least `min_score` replaced by `<KIND>`; overlapping spans become one mark.

    Other columns stay as they are; null texts stay null.
    """
    names = docs.columns

    def step(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        out = []
        for t, known in zip(texts.to_pylist(), part.column("__text").is_valid().to_pylist(), strict=True):
            pieces, at = [], 0
            for k, s, e, v in spans_of(t):
                if v >= min_score and e > at:
                    pieces += [t[at:s], f"<{k.upper()}>"] if s >= at else []
                    at = e
            out.append("".join([*pieces, t[at:]]) if known else None)
        cols = [pa.array(out, pa.string()) if n == text_col else part.column(i) for i, n in enumerate(names)]
        return pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(names))])

    frame = docs.toDF(*[f"c{i}" for i in range(len(names))])
    frame = frame.withColumn("__text", F.col(f"c{names.index(text_col)}"))
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return map_texts(frame, "__text", schema, step).toDF(*names)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the spans' order."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, a digest of the base spans, all spans, and their scores in the spans' order, from find_pii's rows."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(id_col, *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.concat_ws(",", F.transform("spans", lambda s: s["score"].cast("string"))).alias("scores"))
