"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs
them, and a span classifier trained on the outcome decides what is added."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.steps import materialize

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "account", "national_id")
TRAINING_SPANS = 20_000  # spans the classifier is fitted on, at most
DIMENSIONS = 512
CONTEXT_CHARS = 48

# What the gazetteer and context labelers know.
DOMAIN_ENDS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "it", "nl", "eu",
               "info", "example"}
CARD_STARTS = ("34", "36", "37", "38", "4", "51", "52", "53", "54", "55", "60", "62", "64", "65")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43",
                 "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "82", "86", "91")
KEY_NAMES = {"password", "passwd", "pwd", "token", "secret", "api_key", "api-key", "apikey"}
CUES = {
    "email": ("mail", "contact", "write", "correo", "courriel", "address"),
    "ip": ("ip", "host", "server", "address", "ping", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "anruf", "appel", "llam"),
    "secret": ("password", "login", "token", "secret", "key"),
    "account": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social", "security", "id", "number"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_OTHERS = (
    ("phone", re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")),
    ("secret", re.compile(
        r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key)\s?[=:]\s?[\"']?([^\s\"']{6,})")),
    ("account", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
                           r"(?![A-Za-z0-9])")),
    ("national_id", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
)
_SPAN = "struct<kind:string,start:int,end:int,base:boolean,votes:string,features:array<int>>"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: every match has one ``@``, so look around each of them."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans that pass the checks of their kind, and those that only look like it."""
    good = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    weak = []
    for m in _IP.finditer(text):
        ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
                 for p in m.group().split("."))
        (good if ok else weak).append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() <= 64 else m.group()
        n = len(digits) if m.end() - m.start() <= 64 else len(_digits(digits))
        if 14 <= n <= 19:
            (good if _luhn(_digits(digits)) else weak).append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = len(_digits(m.group()))
            if 10 <= n <= 15:
                good.append(("phone", m.start(), m.end()))
            elif n < 10:
                weak.append(("phone", m.start(), m.end()))
    return good, weak


def _votes(kind: str, text: str, start: int, end: int, valid: bool) -> str:
    """One character per labeler: ``+`` for, ``-`` against, ``0`` abstains."""
    span, digits = text[start:end], _digits(text[start:end])
    before = text[max(0, start - CONTEXT_CHARS):start].lower()
    known = {
        "email": lambda: span.rsplit(".", 1)[-1].lower() in DOMAIN_ENDS,
        "ip": lambda: not span.startswith(("0.", "127.", "255.")),
        "card": lambda: digits.startswith(CARD_STARTS),
        "phone": lambda: digits.startswith(CALLING_CODES),
        "secret": lambda: any(k in before for k in KEY_NAMES),
        "account": lambda: span[:2].isalpha(),
        "national_id": lambda: not digits.startswith(("000", "666", "9")),
    }[kind]()
    cue = any(c in before for c in CUES[kind])
    against = re.search(r"(?:version|v\.?|§|page|isbn|order|serial)\s?\Z", before) is not None
    left, right = text[start - 1:start], text[end:end + 1]
    apart = not (left.isalnum() or left in tuple("/_=-.")) and not (right.isalnum()
                                                                  or right in tuple("/_=-"))
    if kind == "secret":
        apart = True
    varied = len(set(span)) >= min(4, max(2, len(span) // 4))
    return "".join("+" if v else "-" for v in (valid, known)) + (
        "+" if cue else "-" if against else "0") + ("+" if apart else "-") + (
        "0" if varied else "-")


def _features(kind: str, text: str, start: int, end: int, votes: str) -> list[int]:
    """Hashed features of a span: kind, votes, shape and the words around it."""
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", text[start:end]))[:12]
    near = (text[max(0, start - CONTEXT_CHARS):start].lower().split()[-2:]
            + text[end:end + CONTEXT_CHARS].lower().split()[:1])
    names = [f"k:{kind}", f"s:{kind}:{shape}", *(f"v{i}:{kind}:{v}" for i, v in enumerate(votes)),
             *(f"w:{kind}:{w}" for w in near)]
    return sorted({zlib.crc32(n.encode()) % DIMENSIONS for n in names})


def candidates(text: str) -> list[dict]:
    """All spans that may be personal data, base ones first marked, with their votes."""
    good, weak = base_spans(text)
    spans = [(k, a, b, True, True) for k, a, b in good]
    taken = sorted((a, b) for _, a, b in good)
    more = [(k, a, b, False) for k, a, b in weak]
    for kind, pattern in _OTHERS:
        for m in pattern.finditer(text):
            a, b = m.span(m.lastindex or 0)
            more.append((kind, a, b, kind != "account" or _iban(m.group())))
    ends = list(itertools.accumulate((b for _, b in taken), max))
    starts = np.array([a for a, _ in taken])
    for kind, a, b, valid in more:
        i = int(np.searchsorted(starts, b))  # base spans that begin before this one ends
        if not i or ends[i - 1] <= a:
            spans.append((kind, a, b, False, valid))
    out = []
    for kind, a, b, base, valid in spans:
        votes = _votes(kind, text, a, b, valid)
        out.append({"kind": kind, "start": a, "end": b, "base": base, "votes": votes,
                    "features": _features(kind, text, a, b, votes)})
    return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))


def _iban(text: str) -> bool:
    code = text.replace(" ", "")
    moved = "".join(str(int(c, 36)) for c in code[4:] + code[:4])
    return 15 <= len(code) <= 34 and int(moved) % 97 == 1


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([
        ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()),
        ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))
    for batch in batches:
        found = [candidates(t) if t else [] for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), pa.array(found, kind)], ["_row", "_spans"])


def estimate(patterns: list[tuple[str, str, int]], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Chance that a span is personal data, for each kind and pattern of votes.

    Two-class expectation-maximisation with one table of vote chances per labeler and
    class for each kind, from counts of patterns; starts from the majority. Counts are
    smoothed towards labelers that are right, which also names the classes.
    """
    out = {}
    for kind in sorted({k for k, _, _ in patterns}):
        own = [(v, n) for k, v, n in patterns if k == kind]
        votes = np.array([["-0+".index(c) for c in v] for v, _ in own])
        count = np.array([n for _, n in own], float)
        chance = np.clip(0.5 + 0.2 * (votes - 1).sum(1), 0.05, 0.95)
        toward = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])  # class, vote
        for _ in range(rounds):
            weight = np.stack([count * (1 - chance), count * chance])
            prior = (weight.sum(1) + 2) / (weight.sum() + 4)
            score = np.log(prior)[:, None] + np.zeros((2, len(own)))
            for i in range(votes.shape[1]):
                seen = np.stack([np.bincount(votes[:, i], w, minlength=3) for w in weight])
                table = (seen + toward) / (seen + toward).sum(1, keepdims=True)
                score += np.log(table)[:, votes[:, i]]
            chance = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
        out |= {(kind, v): float(p) for (v, _), p in zip(own, chance)}
    return out


def train(features: list[list[int]], target: list[float], counts: list[int],
          steps: int = 300) -> np.ndarray:
    """Logistic regression on hashed features with soft targets; the last weight is the bias.

    A row counts as often as ``counts`` says.
    """
    weights = np.zeros(DIMENSIONS + 1)
    if not features:
        return weights
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    col = np.fromiter(itertools.chain.from_iterable(features), np.int64, len(row))
    goal, often = np.array(target), np.array(counts, np.float64)
    scale = 1 / (1 + np.bincount(col, often[row], DIMENSIONS))
    for _ in range(steps):
        z = np.bincount(row, weights[col], len(goal)) + weights[-1]
        error = often * (goal - 1 / (1 + np.exp(-np.clip(z, -30, 30))))
        step = np.bincount(col, error[row], DIMENSIONS)
        weights[:-1] += 0.5 * (step * scale - 1e-3 * weights[:-1])
        weights[-1] += 0.5 * error.sum() / often.sum()
    return weights


def find_personal_data(docs: DataFrame, keep: list[str] | None = None,
                       training_spans: int = TRAINING_SPANS) -> DataFrame:
    """Personal data in every document of ``docs``.

    Base spans (e-mail and IP addresses, card and phone numbers that pass their
    checks) always stay. Spans that only look like personal data, and secrets,
    accounts and national identifiers, are added if the final classifier finds them
    likelier than not. Five labelers vote on every candidate: its own format check,
    a gazetteer, the words before it, its borders, and its variety. Their reliability
    comes from expectation-maximisation over the counts of vote patterns of all
    documents (at most 243 per kind), the classifier from at most ``training_spans``
    different candidates, those with the smallest digests, each counted as often as
    it occurs: a line in all documents is one of them.

    ``docs`` needs ``text``. Returns every row with its columns (or those in ``keep``)
    and ``spans``: an array of ``kind, start, end, base`` in code points, end
    exclusive, by start, then kind. Null and empty texts have none; equal texts get
    equal spans; no rows give no rows; other columns may have any name but ``spans``.
    """
    columns = docs.columns if keep is None else keep
    # only texts with one of these characters can hold a candidate
    text = F.when(F.col("text").rlike("[0-9@=:]"), F.col("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"),
                       text.alias("_text"))
    spark = docs.sparkSession
    schema = T.StructType([*rows.select("_row").schema,
                           *T.StructType.fromDDL(f"_spans array<{_SPAN}>")])
    found = materialize(rows.mapInArrow(_find, schema), "spans")

    spans = found.select(F.explode("_spans").alias("s")).select("s.*")
    patterns = [tuple(r) for r in spans.groupBy("kind", "votes").count().collect()]
    chances = estimate(patterns)
    different = materialize(spans.groupBy("features", "kind", "votes").count(), "candidates")
    # those below a digest that leaves about twice as many as wanted, so that tasks send few
    share = min(1.0, 2 * training_spans / max(1, different.count()))
    digest = F.xxhash64("features", "kind", "votes")
    sample = different.where(digest <= int(share * (2 ** 64 - 1)) - 2 ** 63 if share < 1 else F.lit(
        True)).orderBy(digest, "features", "kind", "votes").limit(training_spans).collect()
    weights = train([r.features for r in sample], [chances[r.kind, r.votes] for r in sample],
                    [r["count"] for r in sample])
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("array<boolean>")
    def decide(features: pd.Series) -> pd.Series:
        w = shared.value
        return pd.Series([[bool(w[list(f)].sum() + w[-1] > 0) for f in row] for row in features])

    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                               s["end"].alias("end"), s["base"].alias("base"))
    judged = found.withColumn("_yes", decide(F.transform("_spans", lambda s: s["features"])))
    both = F.arrays_zip("_spans", "_yes")
    kept = F.filter(both, lambda z: z["_spans"]["base"] | z["_yes"])
    return judged.select("_row.*", F.transform(kept, lambda z: plain(z["_spans"])).alias("spans"))


def listed(spans: F.Column) -> F.Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, spans: list) -> str:
    """The text with every span replaced by its kind, overlaps as one span."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at:s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def digest(spans: list[tuple[str, int, int]]) -> str:
    """Lower-case SHA-256 of the base spans as the queries list them."""
    ordered = sorted(spans, key=lambda s: (s[1], BASE_KINDS.index(s[0])))
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in ordered).encode()).hexdigest()
