"""Personal data by weak supervision.

Regular expressions propose spans: strict ones (the base, which always stays) and loose ones for written-around forms.
Five labelers of three kinds (format, gazetteer, context) vote on each proposal or abstain. The corpus is summed up as
counts of vote patterns with the span's features, whose number is fixed. On the votes, expectation-maximisation estimates
each labeler's reliability per kind; the posteriors are the targets of a logistic span classifier, which sees the votes and
what the labelers don't look at: digits, separators, the characters around the span and the word before it. Loose spans that
it accepts are added.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylog.llm.common import settle

KINDS = ("email", "ip", "card", "phone")
_EMAIL_BODY = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}(?: ?[\[(] ?at ?[\])] ?| at )[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(] ?dot ?[\])] ?| dot )[A-Za-z0-9-]{1,63}){1,5}", re.I),
    "ip": re.compile(r"[0-9]{1,3}(?:\[\.\]|\(\.\)| ?\. ?)[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| ?\. ?)[0-9]{1,3}){2}"),
    "card": re.compile(r"[0-9]{4}(?:[ ._/-]{1,2}[0-9]{2,7}){2,4}"),
    "phone": re.compile(r"(?:\(0?[0-9]{2,4}\) ?|\b0?[0-9]{2,4}[ ./-])[0-9]{3,4}[ ./-]?[0-9]{3,4}(?![0-9])"),
}
# Gazetteers and context words.
TOP_DOMAINS = frozenset("com net org edu gov mil int info biz io co de fr es it nl pt pl ru cn jp uk us ca au ch at be se no dk fi eu".split())
DIAL_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98".split())
CARD_PREFIXES = ("34", "37", "4", "51", "52", "53", "54", "55", "6")
CONTEXT = {
    "email": frozenset("email mail e-mail contact write correo courriel mailto".split()),
    "ip": frozenset("ip host server address client adresse direccion".split()),
    "card": frozenset("card visa mastercard credit payment pay tarjeta carte karte kreditkarte".split()),
    "phone": frozenset("phone tel telephone call fax mobile cell telefon telefono appeler".split()),
}
AGAINST = frozenset("version isbn order invoice ticket part serial build release section chapter page".split())
LABELERS = 5


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The strict spans, by kind, then start; positions are code points, ends are exclusive."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL_BODY.match(text, start)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        out += ip_spans(text)
        out += [("card", *m.span()) for m in _CARD.finditer(text) if is_card(m[0])]
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def ip_spans(text: str) -> list[tuple[str, int, int]]:
    """A match of four numbers takes the first four of a chain of dotted numbers, then the next four, and so on; chains are
    found in one sweep, however long a run of digits is."""
    out = []
    for m in _CHAIN.finditer(text):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                found = ".".join(parts[k : k + 4])
                if is_ip(found):
                    out.append(("ip", at, at + len(found)))
                at += len(found) + 1
    return out


def is_ip(found: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in found.split("."))


def is_card(found: str) -> bool:
    digits = [int(c) for c in found if c.isdigit()]
    if not 13 <= len(digits) <= 19:
        return False
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further proposals that overlap no base span of any kind and no earlier proposal of their own."""
    out, starts, ends = [], [], []  # what is taken, as intervals that don't overlap
    for _, s, e in sorted(base, key=lambda x: x[1]):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    kinds = ["email"] if re.search(r"\bat\b|[\[(] ?at", text, re.I) else []
    kinds += ["ip", "card", "phone"] if _DIGIT.search(text) else []
    for kind in kinds:
        for m in _LOOSE[kind].finditer(text):
            k = bisect_left(starts, m.end()) - 1  # the last one that begins before the proposal ends
            if k < 0 or ends[k] <= m.start():
                out.append((kind, *m.span()))
    return out


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """Each labeler's 1 (personal data), 0 (not) or -1 (abstains)."""
    span = text[start:end]
    digits = "".join(_DIGIT.findall(span))
    before = re.findall(r"[\w-]+", text[max(0, start - 40) : start].lower())[-4:]
    if kind == "email":
        joined = re.sub(r"[\s\[(]+at[\s\])]+", "@", span, flags=re.I)
        joined = re.sub(r"[\s\[(]+dot[\s\])]+", ".", joined, flags=re.I)
        shape = bool(_EMAIL_BODY.fullmatch(joined)) and joined.rpartition(".")[2].isalpha()
        known = joined.rpartition(".")[2].lower() in TOP_DOMAINS
    elif kind == "ip":
        shape = is_ip(".".join(re.findall(r"[0-9]+", span)))
        known = -1 if shape and not digits.startswith("0") else 0
    elif kind == "card":
        shape = is_card(digits)
        known = digits.startswith(CARD_PREFIXES)
    else:
        shape = 9 <= len(digits) <= 15
        known = any(digits[:n] in DIAL_CODES for n in (1, 2)) if span[0] == "+" else -1
    context = 1 if CONTEXT[kind] & set(before) else 0 if AGAINST & set(before) else -1
    joint = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return (1 if strict else -1, int(shape), int(known), context, 0 if joint else -1)


def estimate(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior that a vote pattern stands for personal data, by expectation-maximisation per kind: a prior, and for each
    labeler the chances of its three answers given either class (add-one smoothed)."""
    out = {}
    for kind in KINDS:
        keys = sorted(k for k in counts if k[0] == kind)
        if not keys:
            continue
        n = np.array([counts[k] for k in keys], float)
        answers = np.array([k[1] for k in keys]) + 1
        ones, zeros = (answers == 2).sum(axis=1), (answers == 1).sum(axis=1)
        p = (ones + 0.5) / (ones + zeros + 1)
        for _ in range(rounds):
            prior = np.clip((n @ p + 1) / (n.sum() + 2), 0.01, 0.99)
            scores = np.tile(np.log([1 - prior, prior]), (len(keys), 1))
            for j in range(LABELERS):
                for c, weight in enumerate((n * (1 - p), n * p)):
                    chance = np.bincount(answers[:, j], weights=weight, minlength=3) + 1
                    scores[:, c] += np.log(chance / chance.sum())[answers[:, j]]
            p = 1 / (1 + np.exp(np.clip(scores[:, 0] - scores[:, 1], -30, 30)))
        out |= dict(zip(keys, p.tolist()))
    return out


#: The classifier's cells: kinds, answers of the labelers, and per kind the values of the span's features.
DIGITS, SEPARATORS, AROUND, BEFORE = 6, 4, 4, 16
_FEATURES = DIGITS + SEPARATORS + 2 * AROUND + BEFORE
CELLS = len(KINDS) + 3 * LABELERS + len(KINDS) * _FEATURES


def _class(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def cells(text: str, kind: str, start: int, end: int, answers: tuple[int, ...]) -> list[int]:
    """The classifier's cells that hold for a span: its kind, each labeler's answer, how many digits and separators it has,
    the characters around it, and a hash of the word before it."""
    span = text[start:end]
    digits = len(_DIGIT.findall(span))
    before = re.findall(r"\w+", text[max(0, start - 24) : start].lower())
    values = [
        (DIGITS, 0 if digits < 4 else 1 if digits < 9 else 2 if digits < 12 else 3 if digits < 13 else 4 if digits < 17 else 5),
        (SEPARATORS, min(sum(not c.isalnum() for c in span) // 2, SEPARATORS - 1)),
        (AROUND, _class(text[start - 1 : start])),
        (AROUND, _class(text[end : end + 1])),
        (BEFORE, 1 + zlib.crc32(before[-1].encode("utf-8", "surrogatepass")) % (BEFORE - 1) if before else 0),
    ]
    at = KINDS.index(kind)
    out = [at] + [len(KINDS) + 3 * j + a + 1 for j, a in enumerate(answers)]
    base = len(KINDS) + 3 * LABELERS + at * _FEATURES
    for size, value in values:
        out.append(base + value)
        base += size
    return out


def train(counts: dict[tuple[str, tuple[int, ...], tuple[int, ...]], int], steps: int = 400) -> np.ndarray:
    """The span classifier's weight for each cell: logistic regression on the posteriors of the votes, each pattern weighted
    by the log of its count. counts: by kind, votes and cells."""
    votes: Counter = Counter()
    for (kind, answers, _), n in counts.items():
        votes[kind, answers] += n
    soft = estimate(votes)
    theta = np.zeros(CELLS)
    if not soft:
        return theta
    keys = sorted(counts)
    active = np.array([k[2] for k in keys])
    y, weight = np.array([soft[k[:2]] for k in keys]), np.log1p([counts[k] for k in keys])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(theta[active].sum(axis=1), -30, 30)))
        slope = np.bincount(active.ravel(), weights=np.repeat(weight * (p - y), active.shape[1]), minlength=CELLS)
        theta -= slope / weight.sum() + 1e-3 * theta
    return theta


_SPAN = "array<struct<kind:string,start:long,end:long,base:boolean,votes:array<int>,cells:array<int>>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.list_(pa.int32())), ("cells", pa.list_(pa.int32()))]))


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for x in batch.column(1):
            text = x.as_py() or ""
            base = base_spans(text)
            spans = [(*s, True) for s in base] + [(*s, False) for s in loose_spans(text, base)]
            own = []
            for k, s, e, b in spans:
                answers = votes(text, k, s, e, b)
                own.append({"kind": k, "start": s, "end": e, "base": b, "votes": answers, "cells": cells(text, k, s, e, answers)})
            rows.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPAN_TYPE)], ["doc_id", "spans"])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id and spans, an array of (kind, start, end, base, votes, probability) by kind, then start.

    Base spans are always there; others only if the classifier gives them at least threshold. A null text counts as empty
    and has no spans. Null ids and repeated rows are kept; an empty table gives no rows; other columns are ignored.
    Only the counts of patterns (votes and features; bounded whatever the corpus) come to the driver.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    proposed = settle(rows.mapInArrow(_propose, f"doc_id long, spans {_SPAN}"))
    patterns = proposed.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.cells").count().collect()
    theta = train({(r.kind, tuple(r.votes), tuple(r.cells)): r["count"] for r in patterns})

    weights = F.array(*[F.lit(float(w)) for w in theta])

    def judged(s: Column) -> Column:
        z = F.aggregate(s["cells"], F.lit(0.0), lambda total, c: total + F.get(weights, c))
        place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
        return F.struct(place.alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"), s["votes"].alias("votes"), (1 / (1 + F.exp(-z))).alias("probability"))

    def shown(s: Column) -> Column:
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["votes"].alias("votes"), s["probability"].alias("probability"))

    kept = F.filter(F.transform("spans", judged), lambda s: s["base"] | (s["probability"] >= threshold))
    return proposed.select("doc_id", F.transform(F.array_sort(kept), shown).alias("spans"))
