"""Personal data by aggregated weak supervision.

Strict patterns give the base spans. Looser patterns propose further candidates of the same kinds.
Labelers - patterns and checks, gazetteers, context words - vote for, against or not at all on every
candidate; expectation-maximisation over the counts of vote patterns estimates each labeler's
reliability, and a logistic span classifier is fitted to the estimated labels. Counts over the whole
corpus are all that reaches the driver: one row for each pattern of votes and features there is.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOOSE_MAIL = re.compile(r"\s?[\[(](?:at|AT)[\])]\s?|\s(?:at|AT)\s(?=\S{1,63}\s(?:dot|DOT)\s)")
_LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\s?[\[(](?:dot|DOT)[\])]\s?|\s(?:dot|DOT)\s|\.)[A-Za-z0-9-]{1,63})+")
_LOOSE_PHONE = re.compile(r"(?<![0-9+.-])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_LOOSE_CARD = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|(?:[0-9]{4}[\x20-]){3}[0-9]{4})(?![0-9])")

# Gazetteers and context words (fixed values).
_TLDS = frozenset("com org net edu gov info io de fr es uk eu example".split())
_CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel", "schreib"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "anruf", "appel"),
}
_AGAINST = ("version", "isbn", "order", "invoice", "no.", "nr", "id", "release")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str):
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = at = m.end()
        else:
            at += 1


def raw_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, passes its check) of the strict patterns, leftmost and non-overlapping per kind."""
    out = [("email", a, b, True) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text) if "." in text else ():
        out.append(("ip", *m.span(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            out.append(("card", *m.span(), 12 <= len(digits) <= 19 and _luhn(digits)))
    for m in _PHONE.finditer(text) if "+" in text else ():
        out.append(("phone", *m.span(), 9 <= len(_DIGIT.findall(m.group())) <= 15))
    return out


class Taken:
    """Spans joined into runs that do not overlap, in order: whether a span meets one is found by bisection."""

    def __init__(self, spans=()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            self.append(a, b)

    def __iter__(self):
        return zip(self.starts, self.ends)

    def append(self, a: int, b: int) -> None:
        """``a`` is not less than any start so far."""
        if self.ends and a < self.ends[-1]:
            self.ends[-1] = max(self.ends[-1], b)
        else:
            self.starts.append(a)
            self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        k = bisect.bisect_right(self.ends, a)
        return k == len(self.starts) or self.starts[k] >= b


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """Strict spans (True) and looser ones that overlap no strict span (False), in order of start."""
    strict = raw_spans(text)
    base = [(k, a, b) for k, a, b, ok in strict if ok]
    failed = [(k, a, b) for k, a, b, ok in strict if not ok]
    loose = []
    if "at" in text or "AT" in text:
        done = 0
        for m in _LOOSE_MAIL.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            end = _LOOSE_DOMAIN.match(text, m.end()) if start < m.start() else None
            if end:
                loose.append(("email", start, end.end()))
                done = end.end()
    if _DIGIT.search(text):
        loose += [("phone", *m.span()) for m in _LOOSE_PHONE.finditer(text)]
        loose += [("card", *m.span()) for m in _LOOSE_CARD.finditer(text)]
    out = [(k, a, b, True) for k, a, b in base]
    if loose or failed:
        taken = Taken((a, b) for _, a, b in base)
        # failed spans last: their parts may be better; those of a kind are in order
        for part in (sorted(loose, key=lambda x: (x[1], KINDS.index(x[0]))), *([x for x in failed if x[0] == kind] for kind in KINDS)):
            added = Taken()
            for k, a, b in part:
                if taken.free(a, b) and added.free(a, b):
                    out.append((k, a, b, False))
                    added.append(a, b)
            taken = Taken([*taken, *added])
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def votes(text: str, kind: str, a: int, b: int, strict: bool) -> tuple[int, ...]:
    """Votes (1 for, -1 against, 0 none): pattern, check, gazetteer, context, shape, surroundings."""
    span, before = text[a:b], text[max(0, a - 30) : a].lower()
    digits = "".join(c for c in span if c.isascii() and c.isdigit())
    pattern = 1 if strict else 0
    if kind == "email":
        tail = re.split(r"[^A-Za-z0-9]+", span.strip())[-1].lower()
        check, gazetteer = 0, 1 if tail in _TLDS else -1
        shape = 1 if len(span) <= 254 and re.search(r"[A-Za-z]", span) else -1
    elif kind == "ip":
        parts = span.split(".")
        check = 1 if all(len(p) <= 3 and int(p) <= 255 for p in parts) else -1
        gazetteer = 1 if parts[0] in ("10", "127", "192", "172") else 0
        shape = -1 if all(len(p) == 1 for p in parts) or len(span) > 15 else 1
    elif kind == "card":
        check = 1 if 12 <= len(digits) <= 19 and _luhn(digits) else -1
        gazetteer = 1 if digits[:1] in "3456" and len(digits) in (15, 16) else -1
        shape = 1 if re.fullmatch(r"[0-9]{12,19}|(?:[0-9]{4}[ -]){3}[0-9]{4}", span) else -1
    else:
        check = 1 if 9 <= len(digits) <= 15 else -1
        gazetteer = 1 if span.startswith("+") or "555" in span else 0
        shape = 1 if re.search(r"[(). -]", span) else 0
    context = 1 if any(w in before for w in _CONTEXT[kind]) else -1 if any(w in before for w in _AGAINST) else 0
    left, right = text[a - 1 : a], text[b : b + 1]
    around = -1 if (left.isalnum() or right.isalnum() or left in ("$", "#", "/")) else 1
    return pattern, check, gazetteer, context, shape, around


N_VOTES = 6


def features(kind: str, text: str, a: int, b: int, vote: tuple[int, ...]) -> tuple[int, ...]:
    """The pattern of a candidate: kind, votes, a length class and the class of both neighbours."""
    cls = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3
    return (KINDS.index(kind), *vote, min(7, (b - a) // 5), cls(text[a - 1 : a]), cls(text[b : b + 1]))


def _design(patterns: np.ndarray) -> np.ndarray:
    kind = np.eye(len(KINDS))[patterns[:, 0]]
    v = patterns[:, 1 : 1 + N_VOTES]
    length, left, right = np.eye(8)[patterns[:, -3]], np.eye(4)[patterns[:, -2]], np.eye(4)[patterns[:, -1]]
    return np.hstack([kind, v == 1, v == -1, length, left, right]).astype(float)


@dataclass
class SpanModel:
    reliability: dict  # kind: share of right votes of each labeler
    weights: np.ndarray

    def probability(self, patterns: list[tuple[int, ...]]) -> np.ndarray:
        return 1 / (1 + np.exp(-_design(np.array(patterns)) @ self.weights))


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> SpanModel:
    """Expectation-maximisation over vote patterns, kind by kind, then the classifier on its labels."""
    labels, reliability = np.zeros(len(patterns)), {}
    for k, kind in enumerate(KINDS):
        own = patterns[:, 0] == k
        if not own.any():
            continue
        v, n = patterns[own, 1 : 1 + N_VOTES], counts[own].astype(float)
        p = 1 / (1 + np.exp(-v.sum(axis=1).astype(float)))  # start: the votes' majority
        for _ in range(rounds):
            prior = ((p * n).sum() + 1) / (n.sum() + 2)
            right = np.array([((np.where(v[:, j] == 1, p, np.where(v[:, j] == -1, 1 - p, 0)) * n).sum() + 8) / (((v[:, j] != 0) * n).sum() + 10) for j in range(N_VOTES)])
            right = np.clip(right, 0.5, 0.99)
            z = np.log(prior / (1 - prior)) + v @ np.log(right / (1 - right))
            p = 1 / (1 + np.exp(-z))
        labels[own], reliability[kind] = p, right.round(4).tolist()
    x, w = _design(patterns) if len(patterns) else np.zeros((0, 1)), np.zeros(len(KINDS) + 2 * N_VOTES + 16)
    if len(patterns):
        n = counts / counts.sum() * max(100, len(patterns))
        for _ in range(100):
            p = 1 / (1 + np.exp(-x @ w))
            h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
            step = np.linalg.solve(h, x.T @ (n * (labels - p)) - 0.1 * w)
            w = w + np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-6:
                break
    return SpanModel(reliability, w)


def train(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Fit on the candidates of all documents; their patterns are counted before any shuffle."""

    def run(batches):
        count: dict[tuple[int, ...], int] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for kind, a, b, strict in candidates(t) if t else ():
                    f = features(kind, t, a, b, votes(t, kind, a, b, strict))
                    count[f] = count.get(f, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(map(list, count)), pa.list_(pa.int32())), pa.array(list(count.values()), pa.int64())], names=["f", "n"])

    rows = docs.select(text_col).mapInArrow(run, "f array<int>, n long").groupBy("f").agg(F.sum("n").alias("n")).orderBy("f").collect()  # bounded by the number of patterns
    patterns = np.array([r.f for r in rows], int).reshape(len(rows), N_VOTES + 4)
    return fit(patterns, np.array([r.n for r in rows], int))


def find(docs: DataFrame, model: SpanModel, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.5, redact: bool = False) -> DataFrame:
    """``docs`` with ``spans``: kind, start, end (code points, end exclusive), base, probability; in order.

    Base spans always stay; a further candidate stays if the classifier gives it ``threshold``. With
    ``redact`` the text is replaced: every span becomes its kind in brackets. Null and empty texts have
    no spans, and a null text stays null. Columns of ``docs`` with one of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def factory():
        model = shared.value
        known: dict[tuple[int, ...], float] = {}

        def run(texts):
            out, clean = [], []
            for t in texts.to_pylist():
                found = []
                for kind, a, b, strict in candidates(t) if t else ():
                    f = features(kind, t, a, b, votes(t, kind, a, b, strict))
                    if f not in known:
                        known[f] = float(model.probability([f])[0])
                    if strict or known[f] >= threshold:
                        found.append({"kind": kind, "start": a, "end": b, "base": strict, "probability": known[f]})
                out.append(found)
                if redact:
                    parts, at = [], 0
                    for s in found:
                        if s["start"] >= at:
                            parts += [t[at : s["start"]], f"[{s['kind']}]"]
                            at = s["end"]
                        else:  # spans of two kinds overlap: what is left of the second goes too
                            at = max(at, s["end"])
                    clean.append("".join(parts) + t[at:] if t is not None else None)
            made = [pa.array(out, pa.list_(kinds))]
            return made + ([pa.array(clean, pa.string())] if redact else [])

        return run

    kinds = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("probability", pa.float64())])
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()), T.StructField("probability", T.DoubleType())])
    fields = [T.StructField("spans", T.ArrayType(span))] + ([T.StructField(text_col, T.StringType())] if redact else [])
    return add_columns(docs, [text_col], fields, factory, keep)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, the SHA-256 of the base spans' list, and the list of all spans."""
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.base AND s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
