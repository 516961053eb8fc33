"""Personal data: rules, high-recall candidate generators, and gradient-boosted trees that select among them.

Rules find email, ip, card and phone spans; they always stay. Generators propose further spans, which may
overlap: secrets beside a telling name, spelled-out addresses, national phone numbers, social security
numbers, IBANs, IPv6 addresses. Boosted trees score each from its format and its context; a logistic
curve fitted on a held-out fold calibrates the scores, and each kind has the least threshold that reaches
the wanted precision on that fold. Accepted spans that do not overlap a rule's span or a better accepted
one are added. The trees are trained here, on sentences made by a seeded generator of true and decoy
spans; no text of the corpus is learned from.

Offsets are code points, ends exclusive. Null and empty texts have no spans. All patterns run in time
linear in the text. Rows are independent; repeated rows give repeated results; an empty table an empty one.
"""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

# The rules' kinds, in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: all starts in one run of local characters share its @, so each @ is looked at once."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end(), "email"
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base(text: str) -> list[Span]:
    """The rules' spans by start, then kind as listed."""
    found = list(_emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# ---- generators ----------------------------------------------------------------------------------

MORE = ("secret", "spelled_email", "local_phone", "ssn", "iban", "ipv6")
_MARK = {
    "secret": re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+(?![A-Za-z0-9+/_=-])"),
    "spelled_email": re.compile(r"(?<![\w.])[a-z0-9][a-z0-9._-]{0,40}+ ?[\[(]?\b(?:at|AT)\b[\])]? ?[a-z0-9-]{2,40}+ ?[\[(]?\b(?:dot|DOT)\b[\])]? ?[a-z]{2,10}\b"),
    "local_phone": re.compile(r"(?<![\w+])\(?[0-9]{2,5}\)?[ ./-]{1,2}[0-9]{2,4}[ ./-][0-9]{2,6}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "ipv6": re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){2,7}:?(?:[0-9A-Fa-f]{1,4}:?){0,6}(?![\w:])"),
}
_HEAVY = re.compile(r"[0-9]")
#: Kinds whose pattern needs a digit.
_NUMERIC = frozenset(("local_phone", "ssn", "iban"))
_CUES = ("token", "key", "secret", "password", "api", "auth", "tel", "phone", "call", "fax", "mobile", "mail", "contact", "ssn", "social", "iban", "account", "bank", "ip", "host", "server", "version", "order", "hash", "commit", "id")


def candidates(text: str) -> list[Span]:
    found = []
    digit = _HEAVY.search(text) is not None
    for kind, pattern in _MARK.items():
        if kind == "spelled_email":
            if "dot" not in text and "DOT" not in text:
                continue
        elif kind == "ipv6" and ":" not in text or kind in _NUMERIC and not digit:
            continue
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    return found


def _iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def describe(text: str, span: Span) -> list[float]:
    """Format of the span, then its context."""
    start, end, kind = span
    s, before, after = text[start:end], text[max(0, start - 40) : start].lower(), text[end : end + 20].lower()
    n = len(s)
    digits, letters, upper = sum(c.isdigit() for c in s), sum(c.isalpha() for c in s), sum(c.isupper() for c in s)
    counts = [s.count(c) for c in set(s)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
    words = re.findall(r"[a-z]+", before)
    near = set(words[-3:])
    return [
        *(float(kind == k) for k in MORE), float(n), digits / n, letters / n, upper / n, entropy, turns / n, float(luhn(_digits(s))),
        float(all(c in "0123456789abcdef" for c in s.lower())), float(kind == "iban" and _iban_valid(s)), s.count("-") / n, s.count(" ") / n, s.count(":") / n,
        float(kind == "ssn" and s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00"), float(before[-1:] in "\"'=:"), float("=" in before[-4:] or ":" in before[-3:]),
        float(after[:1] in "\"'"), float("(" in s or "[" in s), *(float(c in near) for c in _CUES),
    ]


# ---- boosted trees -------------------------------------------------------------------------------

TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 16


def _bins(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]


def _grow(x: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, depth: int) -> tuple:
    """A node is (leaf value,) or (feature, cut, left, right); gains are those of second-order boosting."""
    g, h = slope.sum(), curve.sum()
    best = (1e-3, None)
    if depth and len(x) >= 20:
        for f, edges in enumerate(cuts):
            if len(edges):
                k = np.searchsorted(edges, x[:, f], "left")
                gl = np.cumsum(np.bincount(k, slope, len(edges) + 1))[:-1]
                hl = np.cumsum(np.bincount(k, curve, len(edges) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (gain[j], (f, float(edges[j])))
    if best[1] is None:
        return (RATE * g / (h + 1),)
    f, cut = best[1]
    left = x[:, f] <= cut
    return (f, cut, *(_grow(x[m], cuts, slope[m], curve[m], depth - 1) for m in (left, ~left)))


def _value(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    f, cut, left, right = tree
    return np.where(x[:, f] <= cut, _value(left, x), _value(right, x))


def boost(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    cuts, margin, trees = _bins(x), np.zeros(len(x)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        trees.append(_grow(x, cuts, y - p, np.maximum(p * (1 - p), 1e-6), DEPTH))
        margin += _value(trees[-1], x)
    return trees


def _examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Sentences with one true or decoy span each; features, labels and kinds of the candidates found in them."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    chars = lambda k, alphabet: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    word = lambda: "".join(pick("the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "la", "ung", "ción", "eau") for _ in range(rng.integers(1, 4)))
    filler = lambda: " ".join(word() for _ in range(rng.integers(2, 8)))
    digit, hexa, b64 = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def iban() -> str:
        tail, land = chars(18, digit), pick("DE", "FR", "ES", "GB", "IT")
        check = 98 - int("".join(str(int(c, 36)) for c in tail + land + "00")) % 97
        return f"{land}{check:02d}{tail}"

    true = {
        "secret": lambda: pick("token", "api_key", "secret", "password", "auth key", "key") + pick(" = ", "=", ": ") + (q := pick('"', "'", "")) + pick(chars(40, hexa), chars(32, hexa), chars(rng.integers(20, 64), b64)) + q,
        "spelled_email": lambda: f"{pick('', 'mail ', 'contact ')}{word()}{pick(' [at] ', ' (at) ')}{word()}{pick(' [dot] ', ' (dot) ')}{pick('com', 'org', 'net', 'de')}",
        "local_phone": lambda: f"{pick('tel', 'phone', 'call', 'mobile', 'fax')}{pick(' ', ': ')}({chars(3, '23456789')}) {chars(3, digit)}-{chars(4, digit)}",
        "ssn": lambda: f"{pick('ssn ', 'social security ', 'ssn: ')}{chars(3, '12345')}-{chars(2, '123456789')}-{chars(4, digit)}",
        "iban": lambda: f"{pick('iban ', 'account ', '')}{iban()}",
        "ipv6": lambda: f"{pick('', 'host ', 'server ', 'ip ')}{':'.join(chars(4, hexa) for _ in range(8))}",
    }
    decoy = {
        "secret": lambda: pick(f"commit {chars(40, hexa)}", f"order {chars(18, digit)}", "-" * int(rng.integers(16, 60)), "=" * 20 + "1", word() * 5 + "1", f"hash {chars(32, hexa)}", "_".join(word() for _ in range(6)) + "2", chars(int(rng.integers(20, 40)), digit), f"{word()}-{word()}-{word()}-{chars(4, digit)}-x"),
        "spelled_email": lambda: f"{word()} at {word()} dot {word()[:9]}",
        "local_phone": lambda: pick(f"order {chars(4, digit)} {chars(3, digit)} {chars(3, digit)}", f"{chars(2, digit)}/{chars(2, digit)}/{chars(4, digit)}", f"version {chars(2, digit)}.{chars(2, digit)}.{chars(2, digit)}", f"{chars(3, digit)} {chars(3, digit)} {chars(3, digit)}"),
        "ssn": lambda: pick(f"000-{chars(2, digit)}-{chars(4, digit)}", f"9{chars(2, digit)}-00-{chars(4, digit)}", f"order {chars(3, digit)}-{chars(2, digit)}-{chars(4, digit)}", f"version 666-{chars(2, digit)}-{chars(4, digit)}"),
        "iban": lambda: pick(f"order {chars(2, 'ABCDEFGH')}{chars(18, digit)}", f"{chars(2, 'ABCDEFGH')}{chars(2, digit)} {chars(4, b64[:26])} {chars(4, b64[:26])} {chars(4, b64[:26])}"),
        "ipv6": lambda: f"{chars(2, '01')}:{chars(2, '012345')}:{chars(2, '012345')}",
    }
    x, y, kinds = [], [], []
    for _ in range(n):
        kind, label = pick(*MORE), int(rng.integers(2))
        text = f"{filler()} {(true if label else decoy)[kind]()} {filler()}."
        for s in candidates(text):
            if s[2] == kind:
                x.append(describe(text, s))
                y.append(label)
                kinds.append(kind)
    return np.array(x, float), np.array(y, float), kinds


@functools.cache
def model(precision: float = 0.99, n: int = 5000, seed: int = 11) -> dict:
    """Trees, calibration and a threshold for each kind; a kind that never reaches the precision adds nothing."""
    x, y, _ = _examples(n, seed)
    trees = boost(x, y)
    x, y, kinds = _examples(n // 2, seed + 1)
    margin = sum(_value(t, x) for t in trees)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic curve
        p = 1 / (1 + np.exp(-(a * margin + b)))
        d, w = y - p, p * (1 - p)
        slope = np.array([(d * margin).mean() - 1e-3 * a, d.mean()])
        curve = np.array([[(w * margin**2).mean() + 1e-3, (w * margin).mean()], [(w * margin).mean(), w.mean() + 1e-6]])
        a, b = np.array([a, b]) + np.linalg.solve(curve, slope)
    p = 1 / (1 + np.exp(-(a * margin + b)))
    cuts = {}
    for kind in MORE:
        own = np.array([k == kind for k in kinds])
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        fine = np.flatnonzero(right >= precision)
        cuts[kind] = max(0.5, float(p[own][order][fine[-1]])) if len(fine) else 2.0
    return {"trees": trees, "a": float(a), "b": float(b), "cuts": cuts}


def spans(text: str | None, trained: dict | None = None) -> tuple[list[Span], list[Span]]:
    """The rules' spans, and those with the accepted candidates."""
    text = text or ""
    fixed = base(text)
    proposed = candidates(text)
    if not proposed:
        return fixed, fixed
    trained = trained or model()
    x = np.array([describe(text, s) for s in proposed])
    p = 1 / (1 + np.exp(-(trained["a"] * sum(_value(t, x) for t in trained["trees"]) + trained["b"])))
    added, held = [], covered(fixed)  # disjoint ranges in order
    accepted = sorted((-q, s) for q, s in zip(p.tolist(), proposed, strict=True) if q >= trained["cuts"][s[2]])
    for _, s in accepted:
        k = bisect_left(held, (s[0],))
        if (not k or held[k - 1][1] <= s[0]) and (k == len(held) or s[1] <= held[k][0]):
            held.insert(k, s[:2])
            added.append(s)
    order = (*KINDS, *MORE)
    return fixed, sorted(fixed + added, key=lambda s: (s[0], order.index(s[2]), s[1]))


def covered(found: list[Span]) -> list[tuple[int, int]]:
    """The ranges of spans, overlapping ones together, in order."""
    out: list[tuple[int, int]] = []
    for s, e, _ in sorted(found):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def redact(text: str, found: list[Span]) -> str:
    """Each span, overlapping ones together, becomes its first kind in brackets."""
    out, at = [], 0
    merged: list[list] = []
    for s, e, k in sorted(found):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    for s, e, k in merged:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, counts of the rules' kinds, base_sha256, spans, n_spans, and the redacted text if keep_text."""
    trained = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                given = part.column("text").to_pylist()
                both = [spans(t, trained) for t in given]
                columns = {"doc_id": part.column("doc_id")}
                columns |= {f"n_{k}": pa.array([sum(s[2] == k for s in fixed) for fixed, _ in both], pa.int64()) for k in KINDS}
                columns |= {"base_sha256": [common.sha(joined(fixed).encode()) for fixed, _ in both], "spans": [joined(a) for _, a in both], "n_spans": pa.array([len(a) for _, a in both], pa.int64())}
                if keep_text:
                    columns["redacted"] = pa.array([None if t is None else redact(t, a) for t, (_, a) in zip(given, both, strict=True)], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return common.texts(docs).mapInArrow(run, schema + ", redacted string" * keep_text)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with redacted texts; n_chars, where there is such a column, follows; other columns stay."""
    trained, schema = model(), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                new = [None if t is None else redact(t, spans(t, trained)[1]) for t in part.column("text").to_pylist()]
                k = part.schema.get_field_index("text")
                part = part.set_column(k, part.schema.field(k), pa.array(new, part.schema.field(k).type))
                if (k := part.schema.get_field_index("n_chars")) >= 0:
                    counted = [None if t is None else len(t) for t in new]
                    part = part.set_column(k, part.schema.field(k), pa.array(counted, part.schema.field(k).type))
                yield part

    return docs.mapInArrow(run, schema)
