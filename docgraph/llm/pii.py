"""Personal data: fixed patterns, and candidates that boosted trees judge by format and context.

High-recall generators propose overlapping spans. Gradient-boosted trees, trained here with Spark ML on the
candidates of a bounded sample of documents, learn what format and context tell from those that a pattern with
its check confirms (positive), and from those that fail a check or stand in a contrary context (negative). All
others are open: they are no training rows, and they alone are scored. What only patterns have ('+', '@', the
country code, the separators) is hidden from the trees, so that an open form can look like a confirmed one. A threshold
for each kind, calibrated on the labelled candidates of all documents outside the fit, selects the spans that are added; pattern
spans always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .shingles import slices
from .spans import Span, Taken, digest, written

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

_GENERATORS = (
    ("email", re.compile(r"(?<![^\s<>\"'(,;])[^\s<>\"'(),;@]{1,64}(?:@|\x20?[\[(]at[\])]\x20?)[^\s<>\"'(),;@]{3,}")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])(?:\+|\(|00)?[0-9][0-9\x20()./-]{6,20}[0-9](?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9A-Za-z])")),
    ("ip", re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z.])")),
)
_CONTEXT = re.compile(r"phone|tel|call|mobile|fax|mail|contact|card|visa|credit|account|addr|host|server|write|reach|\bip\b", re.I | re.A)
_CONTRARY = re.compile(r"order|invoice|isbn|issn|version|serial|ticket|article|page|part|sku|price|total|amount|date|\bno\b", re.I | re.A)
_CARD_CONTEXT = re.compile(r"card|visa|credit|amex|payment", re.I | re.A)
_PHONE_CONTEXT = re.compile(r"phone|tel|call|mobile|fax|contact|reach", re.I | re.A)
_DATE = re.compile(r"(?:(?:19|20)[0-9]{2}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2(?:19|20)[0-9]{2})(?![0-9])")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
_AT = re.compile(r"\x20?[\[(]at[\])]\x20?")
_COUNTRY = re.compile(r"\+[0-9]{1,3}[\x20.-]?(?=\(|[0-9])")
REACH = 40
#: Documents whose candidates the trees are trained on, at most.
MOST_SAMPLED, TREES, DEPTH, PRECISION = 20_000, 20, 3, 0.98


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_SET:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            found.append(("email", start, last))
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> list[Span]:
    """The pattern spans by kind as in KINDS, then start; every pattern takes time linear in the text."""
    found = _emails(text)
    if _DIGITS.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = "".join(_DIGITS.findall(m[0]))
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return found


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data; spans of different kinds may overlap."""
    found = []
    has_digit = _DIGITS.search(text) is not None
    for kind, pattern in _GENERATORS:
        if has_digit if kind != "email" else ("@" in text or "at)" in text or "at]" in text):
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    return found


def verdict(text: str, span: Span, base: Taken) -> bool | None:
    """True if a pattern of its kind confirms the candidate, False if a check or the context speaks against it, else None."""
    kind, start, end = span
    if base.meets(start, end, kind):
        return True
    if base.meets(start, end) or kind == "ip":
        return False
    own, before = text[start:end], text[max(0, start - REACH) : start]
    digits = "".join(_DIGITS.findall(own))
    if kind == "email":
        at = _AT.search(own)
        return None if at and own[at.start() - 1] in _LOCAL_SET and _DOMAIN.match(own, at.end()) else False
    if kind == "card":
        bare = own.isdigit() and len(digits) < 16 and not _CARD_CONTEXT.search(before)
        return False if bare or not 13 <= len(digits) <= 19 or not luhn(digits) else None
    announced = _PHONE_CONTEXT.search(before) is not None
    if not 7 <= len(digits) <= 15 or _DATE.match(own) or _DOTTED.fullmatch(own):
        return False
    return None if announced or not own.isdigit() and not _CONTRARY.search(before) else False


def _hidden(text: str, span: Span) -> list[str]:
    """The candidate without what only a pattern has; a phone with a country code also without that."""
    kind, start, end = span
    own = text[start:end]
    if kind == "email":
        return [_AT.sub("@", own)]
    if kind == "phone":
        forms = [own.lstrip("+")] + [own[m.end() :] for m in [_COUNTRY.match(own)] if m]
        return [x.replace(".", "-") for x in forms]
    return [own.replace(".", "-") if kind == "card" else own]


FEATURES = (
    "kind", "length", "digits", "letters", "separators", "dots", "parenthesis", "runs", "longest_run", "luhn", "small_parts",
    "context", "space_before", "space_after", "distinct_digits",
)


def features(text: str, span: Span, form: str | None = None) -> list[float]:
    """The features of a candidate, of its first hidden form if none is given."""
    kind, start, end = span
    own = _hidden(text, span)[0] if form is None else form
    runs = re.findall(r"[0-9]+", own)
    digits = "".join(runs)
    return [
        float(KINDS.index(kind)), float(len(own)), float(len(digits)), float(sum(c.isalpha() for c in own)), float(sum(c in " -/" for c in own)),
        float(own.count(".")), float("(" in own), float(len(runs)), float(max(map(len, runs), default=0)),
        float(bool(digits) and luhn(digits)), float(all(len(r) <= 3 and int(r) <= 255 for r in runs)),
        float(_CONTEXT.search(text, max(0, start - REACH), start) is not None),
        float(start == 0 or text[start - 1].isspace()), float(end == len(text) or text[end].isspace() or text[end] in ".,;"), float(len(set(digits))),
    ]


class Trees:
    """Boosted trees as arrays, to score many candidates at once."""

    def __init__(self, trees: list[tuple[float, list[tuple[int, float, int, int, float]]]], thresholds: list[float]):
        self.trees, self.thresholds = trees, np.array(thresholds)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The chance of each row of being personal data."""
        total = np.zeros(len(rows))
        for weight, nodes in self.trees:
            feature, split, low, high, value = (np.array(c) for c in zip(*nodes, strict=True))
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                inner = feature[at] >= 0
                goes_low = rows[np.arange(len(rows)), np.maximum(feature[at], 0)] <= split[at]
                at = np.where(inner, np.where(goes_low, low[at], high[at]), at)
            total += weight * value[at]
        return 1 / (1 + np.exp(-2 * total))


def _nodes(node, out: list) -> int:
    """Appends a Spark ML tree below ``node`` to ``out``; its place there."""
    at = len(out)
    out.append(None)
    if node.subtreeDepth() == 0:
        out[at] = (-1, 0.0, at, at, float(node.prediction()))
    else:
        low, high = _nodes(node.leftChild(), out), _nodes(node.rightChild(), out)
        out[at] = (node.split().featureIndex(), float(node.split().threshold()), low, high, 0.0)
    return at


def _examples(text: str) -> Iterator[tuple[list[float], float]]:
    """(features, label) of the candidates that are not open, in every hidden form."""
    base = Taken(base_spans(text))
    for span in candidates(text):
        label = verdict(text, span, base)
        if label is not None:
            for form in _hidden(text, span):
                yield features(text, span, form), float(label)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            found = [x for text in batch.column("text").to_pylist() for x in _examples(text)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([y for _, y in found], pa.float64()), pa.array([x for x, _ in found], pa.list_(pa.float64()))], names=["label", "x"]
            )


def _banded(shared):
    """(kind, band, positive, n): the labelled candidates of a batch by their chance in steps of 1/50."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [x for text in batch.column("text").to_pylist() for x in _examples(text)]
                if found:
                    rows = np.array([x for x, _ in found])
                    place = rows[:, 0].astype(np.int64) * 51 + np.floor(shared.value.score(rows) * 50).astype(np.int64)
                    n, positive = np.bincount(place), np.bincount(place, [y for _, y in found])
                    some = np.flatnonzero(n)
                    columns = [some // 51, some % 51, positive[some], n[some]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "band", "positive", "n"])

    return count


def train(docs: DataFrame, most_sampled: int = MOST_SAMPLED) -> Trees | None:
    """The trees, trained on candidates of at most about ``most_sampled`` documents and calibrated on those of all others; None
    without two kinds of label.

    The sample is by a hash of doc_id: the same rows give the same trees.
    """
    share = min(1.0, most_sampled / max(1, docs.count()))
    place = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30))
    given = docs.where("text is not null").select("text", ((place % 4 > 0) & (place < share * (1 << 30))).alias("fitted"))
    fit = cut(given.where("fitted").select("text").mapInArrow(_labelled, "label double, x array<double>").select("label", array_to_vector("x").alias("features")))
    if fit.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=3, cacheNodeIds=False).fit(fit)
    trees = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        _nodes(tree._java_obj.rootNode(), nodes := [])
        trees.append((float(weight), nodes))
    shared = docs.sparkSession.sparkContext.broadcast(Trees(trees, [1.0] * len(KINDS)))
    bands = given.where("not fitted").select("text").mapInArrow(_banded(shared), "kind long, band long, positive double, n long")
    rows = [tuple(r) for r in bands.groupBy("kind", "band").agg(F.sum("positive"), F.sum("n")).collect()]  # 51 a kind at most
    return Trees(trees, [_threshold(sorted((r[1:] for r in rows if r[0] == k), reverse=True)) for k in range(len(KINDS))])


def _threshold(bands: list[tuple[int, float, int]]) -> float:
    """The lowest chance, in steps of 1/50 and 0.5 at least, above which kept-out candidates are as precise as wanted."""
    right = total = 0
    best = 0.98
    for band, positive, n in bands:
        right, total = right + positive, total + n
        if band >= 25 and right >= PRECISION * total:
            best = band / 50
    return best


def _scanner(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [x or "" for x in batch.column("text").to_pylist()]
                base = [base_spans(x) for x in texts]
                added = added_spans(texts, base, shared.value)
                counts = [pa.array([sum(s[0] == kind for s in own) for own in base], pa.int64()) for kind in KINDS]
                spans = [written(sorted(own + new, key=lambda s: (KINDS.index(s[0].removeprefix("likely_")), s[1]))) for own, new in zip(base, added, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *counts, pa.array([digest(own) for own in base], pa.string()), pa.array(spans, pa.string())],
                    names=["doc_id", *[f"n_{kind}" for kind in KINDS], "base_sha256", "spans"],
                )

    return scan


def added_spans(texts: list[str], base: list[list[Span]], trees: Trees | None) -> list[list[Span]]:
    """The open candidates that the trees select and that overlap no likelier candidate."""
    out: list[list[Span]] = [[] for _ in texts]
    if trees is None:
        return out
    known, taken = [Taken(own) for own in base], [Taken() for _ in texts]
    found = [(i, span) for i, text in enumerate(texts) for span in candidates(text) if verdict(text, span, known[i]) is None]
    if not found:
        return out
    rows = np.array([features(texts[i], span) for i, span in found])
    chance = trees.score(rows)
    for k in sorted(np.flatnonzero(chance >= trees.thresholds[rows[:, 0].astype(int)]), key=lambda k: (-chance[k], found[k][1][1])):
        i, (kind, start, end) = found[k]
        if not taken[i].meets(start, end):
            taken[i].add(("any", start, end))
            out[i].append((f"likely_{kind}", start, end))
    return out


def scan_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of (doc_id, text, ...).

    ``spans`` lists all spans as kind:start:end, comma-joined, by kind, then start; the kinds likely_* are those that the
    trees add. Counts and base_sha256 are of the pattern spans alone. Null text counts as empty, and an empty text has
    no spans. A null doc_id is passed through, rows that repeat a doc_id each give a row, other columns are ignored,
    and an empty table gives an empty result. The trees are fitted on the candidates of at most about ``MOST_SAMPLED`` documents; where
    those have no candidates of both labels, only patterns count.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    return docs.mapInArrow(
        _scanner(shared), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )
