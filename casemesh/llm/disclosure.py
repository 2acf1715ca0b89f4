"""Personal data, and the terms that give it away.

Patterns find the protected entities: mail addresses, network addresses, card and phone
numbers. Over the whole corpus it is counted in how many documents an entity, a term, and
both close together appear. With N documents, a term t tells about an entity e the pointwise
mutual information log(N * both / (n_t * n_e)), and e as a whole is worth log(N / n_e). Where
the first reaches ``share`` of the second in at least ``support`` documents, t discloses e,
and t is sanitised in the documents that hold e close to it. The share is below 1, which only
a term that occurs nowhere else could reach.

An exact value seldom recurs, so every entity counts at three levels: its value, what it
belongs to (the domain of a mail address, the network of an address, the issuer of a card,
the area of a phone number), and its kind. A term that gives away one of them is sanitised.

A span is ``kind:start:end`` in code points, end exclusive. Disclosing terms have the kind
``term``; they never overlap a base span, and base spans always stay.

Defined cases: null texts count as empty and have no span; rows that repeat, ids included,
are documents of their own; rows without id are treated like others; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from string import ascii_letters, digits
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemesh.llm.learning import fresh, worker_state
from casemesh.llm.words import FOLDED_VALUES, PUNCTUATION, mix, slices, words
from casemesh.session import materialize, materialize_counted

# Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
LOCAL_CHARACTERS = frozenset(f"{ascii_letters}{digits}._%+-")
MAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits can only match from its beginning to its end, hence the possessive forms.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")
# Leading digits that name the issuer of a card, and the country and area of a phone.
AREA_DIGITS = {"card": 6, "phone": 4}

Span = tuple[str, int, int]


class Disclosure(NamedTuple):
    """``near``: words on either side of an entity that count as close to it."""

    near: int = 8
    support: int = 3
    share: float = 0.9


def mail_spans(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each ``@``: what stands before it, as far as the match
    before, and the domain behind it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        end = at
        if at >= done and (behind := MAIL_DOMAIN.match(text, at)):
            start = at
            while start > done and text[start - 1] in LOCAL_CHARACTERS:
                start -= 1
            if start < at:
                out.append((start, behind.end()))
                done = end = behind.end()
        at = text.find("@", max(at + 1, end))
    return out


def passes_luhn(number: str) -> bool:
    values = [int(c) for c in reversed(number)]
    doubled = [d * 2 - 9 * (d > 4) for d in values[1::2]]
    return (sum(values[::2]) + sum(doubled)) % 10 == 0


def _ip(text: str) -> bool:
    parts = [part.lstrip("0") for part in text.split(".")]
    return all(len(part) <= 3 and int(part or 0) <= 255 for part in parts)


def _card(text: str) -> bool:
    own = "".join(DIGITS.findall(text))
    return 12 <= len(own) <= 19 and passes_luhn(own)


def _phone(text: str) -> bool:
    return 9 <= len(DIGITS.findall(text)) <= 15


def base_spans(text: str) -> list[Span]:
    """Spans of all kinds by start, then kind. A match that fails its test is gone."""
    found = [("email", *span) for span in mail_spans(text)]
    for kind, pattern, test in (("ip", IP, _ip), ("card", CARD, _card), ("phone", PHONE, _phone)):
        found += [(kind, *m.span()) for m in pattern.finditer(text) if test(m.group())]
    return sorted(found, key=lambda span: (span[1], KINDS.index(span[0])))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def entity_levels(kind: str, value: str) -> tuple[str, str, str]:
    """The entity itself, what it belongs to, and its kind, whatever its case or separators."""
    plain = value.lower() if kind == "email" else re.sub("[^0-9.]", "", value)
    if kind == "email":
        wider = plain[plain.index("@") :]
    elif kind == "ip":
        wider = ".".join(plain.split(".")[:2])
    else:
        wider = plain.replace(".", "")[: AREA_DIGITS[kind]]
    return f"{kind}:{plain}", f"{kind}<{wider}", kind


def entity_codes(kind: str, value: str) -> list[int]:
    """One number per level of an entity."""
    return [
        int.from_bytes(hashlib.blake2b(level.encode(), digest_size=8).digest(), "little", signed=True)
        for level in entity_levels(kind, value)
    ]


def near_terms(
    text: str, spans: list[Span], near: int
) -> tuple[list[tuple[int, int]], list[tuple[int, list[int]]]]:
    """``(entity, term)`` of the terms close to each entity of a text, at all its levels, and once per term the
    starts and ends of all its places in the text that overlap no base span."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    found = words(data, np.array([0, len(data)]), PUNCTUATION, FOLDED_VALUES)
    place = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    start, end = place[found.start], place[found.end]
    free = np.ones(len(start), dtype=bool)
    for _, low, high in spans:
        free &= (end <= low) | (start >= high)
    code = found.code.view(np.int64)
    pairs: dict[tuple[int, int], None] = {}
    for kind, low, high in spans:
        entities = entity_codes(kind, text[low:high])
        first, last = np.searchsorted(end, low, "right"), np.searchsorted(start, high, "left")
        around = np.r_[max(0, first - near) : first, last : last + near]
        around = around[around < len(code)]
        for term in code[around[free[around]]].tolist():
            for entity in entities:
                pairs[entity, term] = None
    close = np.array(sorted({term for _, term in pairs}), dtype=np.int64)
    at = np.flatnonzero(np.isin(code, close) & free)
    at = at[np.argsort(code[at], kind="stable")]
    edges = np.stack([start[at], end[at]], axis=1)
    places = np.split(edges, np.searchsorted(code[at], close)[1:]) if len(close) else []
    return list(pairs), [(term, own.ravel().tolist()) for term, own in zip(close.tolist(), places)]


BASE_SCHEMA = (
    "row long, doc_id long, spans array<struct<kind: string, start: int, end: int>>, "
    "close array<struct<entity: long, term: long>>, "
    "places array<struct<term: long, places: array<int>>>"
)
SPANS_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
CLOSE_TYPE = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64())]))
PLACES_TYPE = pa.list_(pa.struct([("term", pa.int64()), ("places", pa.list_(pa.int32()))]))


def find_entities(docs: DataFrame, config: Disclosure) -> DataFrame:
    """Base spans of every row, and the terms close to them. Rows get a number of their own."""

    def run(batches):
        worker_state("disclosure")
        for batch in batches:
            spans, close, places = [], [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                own = base_spans(text)
                spans.append([dict(zip(("kind", "start", "end"), span)) for span in own])
                pairs, found = near_terms(text, own, config.near) if own else ([], [])
                close.append([dict(zip(("entity", "term"), pair)) for pair in pairs])
                places.append([dict(zip(("term", "places"), place)) for place in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(spans, SPANS_TYPE),
                    pa.array(close, CLOSE_TYPE),
                    pa.array(places, PLACES_TYPE),
                ],
                ["row", "doc_id", "spans", "close", "places"],
            )

    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long"),
        F.col("text").cast("string"),
    ).mapInArrow(run, BASE_SCHEMA)


def document_frequency(docs: DataFrame) -> DataFrame:
    """``term, documents``: over the whole corpus, counted in each task before the shuffle."""

    def run(batches):
        worker_state("disclosure")
        codes, counts = [], []
        for batch in batches:
            for part in slices(batch.column(0)):
                found = words(part.data, part.bounds, PUNCTUATION, FOLDED_VALUES)
                own = found.code ^ mix(found.text.astype(np.uint64))
                first = np.unique(own, return_index=True)[1]
                code, count = np.unique(found.code[first], return_counts=True)
                codes.append(code)
                counts.append(count)
            if sum(map(len, codes)) > 1 << 21:
                codes, counts = _merged(codes, counts)
        if codes:
            codes, counts = _merged(codes, counts)
            for low in range(0, len(codes[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(codes[0][low : low + (1 << 16)].view(np.int64)),
                        pa.array(counts[0][low : low + (1 << 16)]),
                    ],
                    ["term", "documents"],
                )

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "term long, documents long")
    return counted.groupBy("term").agg(F.sum("documents").alias("documents"))


def _merged(codes: list, counts: list) -> tuple[list, list]:
    code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return [code], [np.bincount(inverse, np.concatenate(counts), len(code)).astype(np.int64)]


def disclosing_terms(docs: DataFrame, entities: DataFrame, rows: int, config: Disclosure) -> DataFrame:
    """``entity, term, information, worth`` of the pairs above the threshold."""
    pairs = entities.select("row", F.explode("close").alias("c")).select("row", "c.entity", "c.term")
    both = (
        pairs.groupBy("entity", "term")
        .agg(F.count(F.lit(1)).alias("both"))
        .where(F.col("both") >= config.support)
    )
    held = (
        entities.select(F.explode(F.array_distinct(F.transform("close", lambda c: c["entity"]))).alias("entity"))
        .groupBy("entity")
        .agg(F.count(F.lit(1)).alias("holders"))
    )
    both = materialize(both.join(held, "entity"), "disclosure-pairs")
    terms = both.select("term").distinct()
    known = document_frequency(docs).join(terms, "term", "left_semi")
    information = F.log2(F.lit(float(rows)) * F.col("both") / (F.col("documents") * F.col("holders")))
    worth = F.log2(F.lit(float(rows)) / F.col("holders"))
    return (
        both.join(materialize(known, "disclosure-terms"), "term")
        .select("entity", "term", information.alias("information"), worth.alias("worth"))
        .where((F.col("worth") > 0) & (F.col("information") >= config.share * F.col("worth")))
    )


def disclosure_spans(docs: DataFrame, config: Disclosure = Disclosure()) -> DataFrame:
    """``doc_id, base, spans`` of every row: base spans, and these with the disclosing terms,
    by start; both are arrays of ``kind, start, end``."""
    entities, seen = materialize_counted(find_entities(docs, config), "disclosure-entities")
    told = materialize(disclosing_terms(docs, entities, seen["rows"], config), "disclosure-told")
    # Which terms of which rows disclose something; few beside the rows.
    terms = materialize(
        entities.select("row", F.explode("close").alias("c"))
        .select("row", "c.entity", "c.term")
        .join(told.select("entity", "term"), ["entity", "term"], "left_semi")
        .groupBy("row")
        .agg(F.collect_set("term").alias("told")),
        "disclosure-added",
    )

    def of_term(place):
        own = place["places"]
        return F.transform(
            F.sequence(F.lit(0), F.size(own) - 1, F.lit(2)),
            lambda i: F.struct(
                F.lit(TERM).alias("kind"),
                F.get(own, i).alias("start"),
                F.get(own, i + 1).alias("end"),
            ),
        )

    disclosing = F.filter("places", lambda p: F.array_contains("told", p["term"]))
    added = F.when(F.col("told").isNotNull(), F.flatten(F.transform(disclosing, of_term)))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    both = F.concat("spans", F.coalesce(added, none))
    ordered = F.array_sort(
        F.transform(
            both,
            lambda s: F.struct(
                s["start"].alias("start"),
                F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"),
                s["end"].alias("end"),
                s["kind"].alias("kind"),
            ),
        )
    )
    plain = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return (
        entities.select("row", "doc_id", "spans", "places")
        .join(terms, "row", "left")
        .select("doc_id", F.col("spans").alias("base"), plain.alias("spans"))
    )


def span_list(spans):
    """``kind:start:end`` of an array of spans, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def generalise(text: str, spans: list[Span]) -> str:
    """The text with every span replaced: entities by their kind, disclosing numbers by
    ``[NUMBER]``, other disclosing terms removed. Overlapping spans are replaced as one."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < done:
            if end > done:
                done = end
            continue
        out.append(text[done:start])
        if kind != TERM:
            out.append(f"[{kind.upper()}]")
        elif text[start:end].isdigit():
            out.append("[NUMBER]")
        done = end
    out.append(text[done:])
    return "".join(out)


def sanitise(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``doc_id, spans`` generalised or removed in ``text``; ids
    must be unique. Rows without spans stay as they are."""
    added = fresh("spans", docs.columns)
    joined = docs.join(spans.select("doc_id", F.col("spans").alias(added)), "doc_id", "left")
    names = list(docs.columns)
    at = {name: place for place, name in enumerate(joined.columns)}

    def run(batches):
        worker_state("disclosure")
        for batch in batches:
            texts = [
                text if text is None or not own else generalise(text, [tuple(s.values()) for s in own])
                for text, own in zip(
                    batch.column(at["text"]).to_pylist(), batch.column(at[added]).to_pylist()
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(texts, pa.string()) if c == "text" else batch.column(at[c])
                    for c in names
                ],
                names,
            )

    return joined.mapInArrow(run, docs.schema)
