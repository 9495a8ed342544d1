"""Personal data: fixed rules, and candidate spans judged by gradient-boosted trees."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, slices, utf8

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the model adds.
MORE = ("national_id", "iban")
ORDER = {k: i for i, k in enumerate(KINDS + MORE)}

#: Boosting: rounds, depth and shrinkage.
ROUNDS, DEPTH, SHRINK = 60, 3, 0.2
#: Examples of the training set, which is made by rule; a third of them calibrates.
EXAMPLES = 9000
#: Precision that each kind's threshold must show on the calibration part.
PRECISION = 0.98
#: Characters of context at each side.
CONTEXT = 32

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed rules' spans, leftmost and non-overlapping for each kind.

    An email's local part is the run of its characters before an at sign, and
    no such run holds one, so each at sign decides for itself; searching from
    the at signs keeps long runs of letters cheap.
    """
    out: list[tuple[str, int, int]] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


# Generators of candidates. They overlap and take far too much; the model decides.
_AT = re.compile(r"(?:[(\[{]\s?at\s?[)\]}]|(?<=[ \w])\sat\s|@)\s?[A-Za-z0-9-]{1,63}", re.I)
_DOT = re.compile(r"\s?(?:\.|[(\[{]\s?dot\s?[)\]}]|(?<= )dot(?= ))\s?[A-Za-z0-9-]{1,63}", re.I)
_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?\Z")
_DASHED = re.compile(r"(?<![0-9A-Za-z.])\(?[0-9]{2,4}\)?(?:[ ./-]{1,2}[0-9]{2,4}){1,4}(?![0-9A-Za-z])")
_SOLID = re.compile(r"(?<![0-9A-Za-z])[0-9]{9,19}(?![0-9A-Za-z])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\s?[0-9A-Z]{4}){2,7}(?:\s?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
#: Whatever a rule or a generator matches holds one of these: a digit, an at sign, a colon, or the word "at" between spaces or brackets.
_TRIGGER = re.compile(r"[0-9@:]|[\s(\[{]at[\s)\]}]", re.I)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be personal data, each with every kind that its form allows."""
    found: set[tuple[str, int, int]] = set()
    for m in _AT.finditer(text):
        if b := _BEFORE_AT.search(text, max(0, m.start() - 66), m.start()):
            end = m.end()
            found.add(("email", b.start(), end))
            for _ in range(4):  # where a domain ends is for the model to say
                if not (d := _DOT.match(text, end)):
                    break
                end = d.end()
                found.add(("email", b.start(), end))
    for m in _IPV6.finditer(text):
        found.add(("ip", *m.span()))
    for m in _IBAN.finditer(text):
        found.add(("iban", *m.span()))
    for pattern in (_DASHED, _SOLID):
        for m in pattern.finditer(text):
            n = len(_digits(m.group()))
            for kind, lo, hi in (("phone", 7, 15), ("national_id", 9, 11), ("card", 12, 19)):
                if lo <= n <= hi:
                    found.add((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]], s[2]))


#: Words that speak for a kind, and words that speak for a harmless number.
_CUES = {
    "email": ("mail", "contact", "write", "reach", "courriel", "correo", "adresse"),
    "ip": ("ip", "host", "server", "addr", "ping", "client", "ipv6", "inet"),
    "card": ("card", "visa", "mastercard", "credit", "amex", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "appelez", "llame", "whatsapp", "dial", "ring", "text", "sms"),
    "national_id": ("ssn", "social", "security", "national", "insurance", "passport", "dni", "nir"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank", "bic"),
}
_HARMLESS = ("version", "v", "id", "order", "invoice", "isbn", "total", "page", "token", "build", "date", "price", "score", "ticket", "rev", "serial", "sha", "commit", "copyright", "since", "chapter", "doi", "issn", "lot", "qty")
_TLD = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "example")
_TOKEN = re.compile(r"[^\W\d_]+")


def mod97(body: str) -> bool:
    """Whether an account number's check digits are right."""
    d = "".join(str(int(c, 36)) for c in "".join(body.split())[4:] + body[:4] if c.isascii() and c.isalnum())
    return bool(d) and int(d) % 97 == 1


def describe(text: str, span: tuple[str, int, int]) -> list[float]:
    """Features of a span's form and of the characters and words around it."""
    kind, s, e = span
    body, before, after = text[s:e], text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]
    d = _digits(body)
    groups = [len(g) for g in re.findall(r"[0-9]+", body)]
    parts = body.split(":")
    near = {w.lower() for w in _TOKEN.findall(before)[-4:]} | {w.lower() for w in _TOKEN.findall(after)[:2]}
    tail = re.split(r"[^A-Za-z]+", body.lower())[-1]
    longer = _DOT.match(text, e) if kind == "email" else None  # the domain may go on
    return [
        float(longer is not None), float(longer is not None and re.split(r"[^A-Za-z]+", longer.group().lower())[-1] in _TLD),
        *(float(kind == k) for k in ORDER), len(body), len(d), len(groups), max(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        float(luhn(d)) if 12 <= len(d) <= 19 else -1.0, float(mod97(body)) if kind == "iban" else -1.0, len(set(d)), body.count("-"), body.count(" "), body.count("."), body.count("("), body.count("/"), body.count(":"),
        float("::" in body), max(map(len, parts)) if kind == "ip" else 0, min(map(len, parts)) if kind == "ip" else 0,
        float("@" in body), float(bool(re.search(r"[(\[{]\s?at", body, re.I))), float(bool(re.search(r"\sat\s", body, re.I))), float(bool(re.search(r"\bdot\b", body, re.I))), float("." in body), float(tail in _TLD),
        float(any(w.startswith(c) for w in near for c in _CUES[kind])), float(any(w.startswith(c) for w in near for k, cs in _CUES.items() if k != kind for c in cs)), float(bool(near & set(_HARMLESS))),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "=#$€£/\"'" and before != ""), float(before.rstrip()[-1:] == ":"), sum(c.isdigit() for c in before + after) / max(1, len(before + after)),
        float(bool(re.match(r"(?:19|20)[0-9]{2}[-/.]", body))), float(body[:1] == "0"), float(groups == [3, 3, 4]), float(groups == [3, 2, 4]), float(groups in ([4, 4, 4, 4], [4, 6, 5])),
    ]


@dataclass
class Trees:
    """Boosted trees of one depth over binned features, with a calibrated threshold for each kind."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, leaf value
    slope: float = 1.0
    shift: float = 0.0
    threshold: dict[str, float] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def margin(self, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(b))
        for feature, at, value in self.trees:
            node = np.zeros(len(b), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > at[node])
            total += value[node - (2**DEPTH - 1)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(self.bins(x)) + self.shift)))


def boost(x: np.ndarray, y: np.ndarray, kinds: list[str], bins: int = 24) -> Trees:
    """Newton boosting with logistic loss on two thirds of the rows; Platt scaling and thresholds on the rest."""
    fit, rest = np.arange(len(x)) % 3 != 0, np.arange(len(x)) % 3 == 0
    t = Trees([np.unique(np.quantile(x[fit, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])])
    b, target = t.bins(x[fit]), y[fit]
    wide, score = bins + 1, np.zeros(int(fit.sum()))
    columns = np.arange(x.shape[1]) * wide
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = target - p, p * (1 - p)
        feature, at = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, wide)
        node = np.zeros(len(b), np.int64)
        for n in range(2**DEPTH - 1):
            mine = np.flatnonzero(node == n)
            if not len(mine):
                continue
            flat = (b[mine] + columns).ravel()
            gs = np.bincount(flat, np.repeat(g[mine], x.shape[1]), wide * x.shape[1]).reshape(-1, wide).cumsum(1)
            hs = np.bincount(flat, np.repeat(h[mine], x.shape[1]), wide * x.shape[1]).reshape(-1, wide).cumsum(1)
            gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1)
            f, k = np.unravel_index(int(gain.argmax()), gain.shape)
            feature[n], at[n] = f, k
            node[mine] = 2 * n + 1 + (b[mine, f] > k)
        leaf = node - (2**DEPTH - 1)
        value = SHRINK * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        t.trees.append((feature, at, value))
        score += value[leaf]
    m, target = t.margin(t.bins(x[rest])), y[rest]
    for _ in range(200):  # Platt scaling
        p = 1 / (1 + np.exp(-(t.slope * m + t.shift)))
        t.slope -= 0.05 * float(np.mean((p - target) * m))
        t.shift -= 0.05 * float(np.mean(p - target))
    p, names = t.probability(x[rest]), np.array(kinds)[rest]
    for kind in ORDER:
        mine = np.flatnonzero(names == kind)
        order = mine[np.argsort(-p[mine])]
        right = np.cumsum(target[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= PRECISION)
        t.threshold[kind] = max(0.5, float(p[order[good[-1]]])) if len(good) else 2.0
    return t


def examples(n: int = EXAMPLES, seed: int = 5) -> list[tuple[str, tuple[str, int, int], bool]]:
    """Texts made by rule that hold one number or address each, personal or harmless, with all candidates in it."""
    rng = np.random.default_rng(seed)
    syllable = ("an", "the", "ion", "er", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st")

    def word() -> str:
        return "".join(rng.choice(syllable, rng.integers(1, 5)))

    def words(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(rng.integers(lo, hi)))

    def num(k: int) -> str:
        return "".join(map(str, rng.integers(0, 10, k)))

    def card() -> str:
        d = str(rng.choice(["4", "5", "37", "6"])) + num(14)
        d = d[:15]
        return d + next(str(c) for c in range(10) if luhn(d + str(c)))

    def pick(*x: str) -> str:
        return str(x[rng.integers(len(x))])

    def grouped(d: str, sep: str) -> str:
        return sep.join(d[k : k + 4] for k in range(0, len(d), 4))

    def address() -> str:
        """Eight groups in hexadecimal, or fewer with a run of zero groups left out."""
        g = [format(int(v), "x") for v in rng.integers(0, 65536, 8)]
        if rng.integers(2):
            lo = int(rng.integers(1, 5))
            hi = int(rng.integers(lo + 2, 8))
            return ":".join(g[:lo]) + "::" + ":".join(g[hi:])
        return ":".join(g)

    def account() -> str:
        land, rest = pick("DE", "FR", "GB", "ES", "NL", "IT"), num(int(rng.integers(12, 20)))
        check = next(f"{c:02d}" for c in range(2, 99) if mod97(f"{land}{c:02d}{rest}"))
        return land + grouped(check + rest, "")

    #: Lead-ins of personal data that name no kind, and none at all.
    plain = ("reach me at ", "my number: ", "number is ", "mine is ", "or ", "and ", "at ", "on ", "", "", "")
    out = []
    for _ in range(n):
        kind, yes = pick(*ORDER), bool(rng.integers(2))
        named = bool(rng.integers(2))
        cue = pick(*_CUES[kind]) + pick(" ", ": ", " is ", " no. ", " me at ") if named else pick(*plain)
        if yes:
            if kind == "email":
                host, tld = word() + num(rng.integers(0, 2)), pick(*_TLD)
                dot = pick(" (dot) ", " [dot] ", " dot ", "(dot)") if not named or rng.integers(3) else "."
                body = f"{word()}{pick('.' + word(), '_' + num(2), num(2), '')}{pick(' (at) ', '(at)', ' [at] ', '[at]', ' at ')}{host}{pick('', dot + word())}{dot}{tld}"
            elif kind == "ip":
                body = address()
            elif kind == "card":
                body = grouped(card(), pick(".", "/", "  ", " -", "- "))
            elif kind == "phone":
                body = pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)} {num(3)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(3)} {num(3)}{num(4)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}")
                if body[0] == "0" and not named:
                    cue = pick(*_CUES[kind]) + " "  # such groups alone could be anything
            elif kind == "national_id":
                body = f"{num(3)}-{num(2)}-{num(4)}"
            else:
                body = account()
                body = pick(body, grouped(body, " "))
        else:
            cue = pick(cue, pick(*_HARMLESS, word(), word()) + pick(" ", ": ", " = ", " #", ' = "'), pick(*_HARMLESS) + " ")
            harmless = cue.split(" ")[0].rstrip(":") in _HARMLESS
            body = pick(f"{rng.integers(1900, 2030)}-{num(2)}-{num(2)}", num(rng.integers(7, 20)), f"{num(2)}/{num(2)}/{num(4)}", f"{num(1)}.{num(2)}.{num(3)}.{num(4)}", f"{word()} at {word()}", f"{word()} at {word()}. {word()}", f"{num(4)}-{num(4)}", f"{num(2)}:{num(2)}:{num(2)}:{num(2)}", ":".join(format(int(v), "02x") for v in rng.integers(0, 256, 6)), f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(3)} {num(3)} {num(3)}", f"{num(2)}-{num(2)}-{num(3)}", f"{word()}@{word()}", f"{word().upper()[:2]}{num(8)}", f"{pick('DE', 'FR', 'XX', 'AB')}{num(2)} {num(4)} {num(4)} {num(4)} {num(2)}", f"{num(2)} {num(3)} {num(2)} {num(4)}", f"@{word()}", grouped(num(16), pick(".", "/", "  ", " -")), *([f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}-{num(2)}-{num(4)}"] if harmless else []))
        left = words(1, 8) + " " + cue
        text = f"{left}{body}{pick(' ', '. ', ', ', chr(10))}{words(1, 8)}"
        s, e = len(left), len(left) + len(body)
        for c in candidates(text):
            out.append((text, c, yes and c[0] == kind and c[1] == s + (text[s] == "(" and c[1] != s) and c[2] == e))
    return out


def train() -> Trees:
    """The model; its training set is made by rule, so that it needs no labelled personal data."""
    rows = examples()
    return boost(np.array([describe(t, c) for t, c, _ in rows]), np.array([float(y) for _, _, y in rows]), [c[0] for _, c, _ in rows])


class Spread:
    """Spans of which no two overlap, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        """Overlapping spans are united."""
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, s: int, e: int) -> bool:
        k = bisect_left(self.starts, e)
        return k > 0 and self.ends[k - 1] > s

    def add(self, s: int, e: int) -> None:
        k = bisect_right(self.starts, s)
        self.starts.insert(k, s)
        self.ends.insert(k, e)


def added_spans(text: str, base: list[tuple[str, int, int]], model: Trees) -> list[tuple[str, int, int]]:
    """Candidates above their kind's threshold that touch no base span; of overlapping ones the surest stays."""
    fixed = Spread([(s, e) for _, s, e in base])
    free = [c for c in candidates(text) if not fixed.meets(c[1], c[2])]
    if not free:
        return []
    p = model.probability(np.array([describe(text, c) for c in free]))
    taken, out = Spread([]), []
    for k in sorted(range(len(free)), key=lambda k: (-p[k], free[k][1], ORDER[free[k][0]], free[k][2])):
        c = free[k]
        if p[k] >= model.threshold[c[0]] and not taken.meets(c[1], c[2]):
            taken.add(c[1], c[2])
            out.append(c)
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], ORDER[x[0]], x[2])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span, or union of overlapping spans, replaced by the name of its first kind."""
    out, last = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], ORDER[x[0]], x[2])):
        if s >= last:
            out += [text[last:s], f"[{kind}]"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def find(docs: DataFrame, model: Trees | None = None, id_col: str = "doc_id", text_col: str = "text", with_redacted: bool = True) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted) for every row of docs.

    The counts and base_sha256 are of the fixed rules' spans. spans also holds
    what the boosted trees add; offsets are code points, ends exclusive.
    redacted is the text with all spans replaced; a null text counts as empty
    and stays null. Repeated rows each get a row; other columns are not read;
    no rows give no rows.
    """
    kind_ = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model or train())  # ROUNDS small trees
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                data, off = utf8(part.column("t"))
                raw = data.tobytes()
                texts = part.column("t")
                n, sha, spans, red = [[], [], [], []], [], [], []
                for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                    base, more, text = [], [], raw[a:b].decode()
                    if _TRIGGER.search(text):
                        base = base_spans(text)
                        more = added_spans(text, base, shared.value)
                    for i, kind in enumerate(KINDS):
                        n[i].append(sum(x[0] == kind for x in base))
                    sha.append(hashlib.sha256(joined(base).encode()).hexdigest() if base else nothing)
                    spans.append(joined(base + more))
                    if with_redacted:
                        red.append(redact(text, base + more) if texts[k].is_valid else None)
                columns = [part.column("i"), *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array(spans, pa.string())]
                names = ["i", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(red, pa.string())] if with_redacted else []), names=names + (["redacted"] if with_redacted else []))

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    schema = f"i {kind_}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + (", redacted string" if with_redacted else "")
    return arrow(rows, run, schema).withColumnRenamed("i", id_col)
