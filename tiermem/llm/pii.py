r"""Personal data: fixed base patterns, and candidate gradient boosting for what they miss.

High-recall generators propose overlapping spans; boosted trees judge them by format and context; a threshold for each kind, calibrated to a
precision on held-out examples, selects. Selected spans that lie in no base span are added; base spans always stay.

The trees are fitted on the driver on at most TRAIN_SENTENCES made sentences with known spans (fixed seed), whatever the size of the corpus.

Defined cases: null and empty texts have no spans; offsets are code points, ends exclusive; very long texts are scanned whole; rows that repeat
are judged each; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import utf8
from .trees import Boosted, boost, precise_threshold

KINDS = ("email", "ip", "card", "phone")
#: Made sentences that the trees are fitted and calibrated on.
TRAIN_SENTENCES = 6000
PRECISION = 0.995
CONTEXT = 24
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

# fixed values: the base patterns
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# starting at a run of digits only and taking runs whole changes no match, but keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# characters of a loose address, and of what may stand before one
_LOOSE = re.compile(r"[^\s@<>()\[\]\"',;:]++")
_NOT_LOOSE = re.compile(r"[\s@<>()\[\]\"',;:]")
_BEFORE = re.compile(r"[\s<(\[\"',;:]")
_AT = re.compile(r"(?i)[\[({] ?at ?[\])}]")
_HOST = (re.compile(r"(?i) ?+[\w-]++(?:(?:\.| ?[\[({] ?dot ?[\])}] ?)[\w-]++)++"), re.compile(r"(?i) ?+[\w-]++(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[\w-]++)++"))


def _loose_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Runs of address characters to both sides of an at sign, the right one with a dot in it. No run is walked from more than two signs."""
    low = 0
    at = text.find("@")
    while at >= 0:
        cut = max((m.end() for m in _NOT_LOOSE.finditer(text, low, at)), default=low)
        right = _LOOSE.match(text, at + 1)
        if cut < at and right and (not cut or _BEFORE.match(text, cut - 1)):
            host = right[0].rstrip(".!?")
            if host.find(".", 1) > 0:
                yield cut, at + 1 + len(host)
        low = at + 1
        at = text.find("@", low)


def _told_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with a bracketed at: from the word before (with and without its leading marks) to the end of the host, dots with or without spaces."""
    low = 0
    for m in _AT.finditer(text):
        end = m.start() - (text[m.start() - 1 : m.start()] == " ")
        name = _word_back(text[low:end])
        low = m.end()
        starts = {end - len(name), end - len(name.lstrip(".+-"))} if name.strip(".+-") else set()
        for stop in {h.end() for rx in _HOST if (h := rx.match(text, m.end()))} if starts else ():
            yield from ((start, stop) for start in starts)


def _word_back(head: str) -> str:
    """The run of word characters, dots, plus signs and hyphens that head ends with."""
    k = len(head)
    while k and (head[k - 1].isalnum() or head[k - 1] in "_.+-"):
        k -= 1
    return head[k:]


# generators: each proposes at every position where it matches, so spans may overlap. Numbers have the lengths of their formats; addresses have none
_GENERATORS = (
    ("email", _loose_addresses, "@"),
    ("email", _told_addresses, ""),
    ("ip", re.compile(r"(?<![0-9.])(?=([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9]))"), "."),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?=((?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:]))"), ":"),
    ("card", re.compile(r"(?<![0-9])(?=([0-9]{12,19})(?![0-9]))"), ""),
    ("card", re.compile(r"(?<![0-9])(?=([0-9]{4}(?:[ .-][0-9]{4}){2}[ .-][0-9]{1,7})(?![0-9]))"), ""),
    ("card", re.compile(r"(?<![0-9])(?=(3[0-9]{3}[ .-][0-9]{6}[ .-][0-9]{5})(?![0-9]))"), ""),
    ("phone", re.compile(r"(?=(\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4})(?![0-9]))"), "+"),
    ("phone", re.compile(r"(?=(\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){3,5})(?![0-9]))"), "+"),
    ("phone", re.compile(r"(?<![0-9+])(?=(\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4})(?![0-9]))"), "("),
    ("phone", re.compile(r"(?<![0-9+.-])(?=([0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9]))"), ""),
)
_TRIGGER = np.zeros(256, dtype=bool)
_TRIGGER[list(b"0123456789@[({")] = True
_CUES = {"email": ("mail", "contact", "write", "reach"), "ip": ("ip", "host", "server", "address", "ping"), "card": ("card", "visa", "pay", "credit", "charge"), "phone": ("phone", "call", "tel", "fax", "mobile")}
_AGAINST = ("version", "order", "isbn", "invoice", "ticket", "serial", "build", "section", "id", "no", "ref", "v")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted by start and kind."""
    out = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL_TAIL.match(text, at) if start < at else None
        if m:
            out.append((start, 0, done := m.end()))
        at = text.find("@", max(at + 1, done))
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdecimal, m[0])) <= 15]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, generator, end) of what the generators propose."""
    out = []
    for g, (_, made, need) in enumerate(_GENERATORS):
        if need in text:
            out += [(s, g, e) for s, e in (made(text) if callable(made) else (m.span(1) for m in made.finditer(text))) if e > s]
    return out


def features(text: str, start: int, g: int, end: int) -> list[float]:
    kind, span = _GENERATORS[g][0], text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    groups = re.findall(r"[0-9]+", span)
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    near = re.findall(r"[a-z]+", before)[-3:]
    parts = [int(p) for p in groups] if kind == "ip" and "." in span else [0]
    tail = re.split(r"[.\])} ]+", span)[-1]
    return [
        float(KINDS.index(kind)), float(g), float(len(span)), float(len(digits)), len(digits) / len(span), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(luhn(digits)) if kind == "card" else -1.0, float(digits[:1] in tuple("3456") if kind == "card" else 0), float(max(parts) <= 255), float(span.count(".")), float(sum(c in " -().+" for c in span)),
        float(any(c in w for c in _CUES[kind] for w in near)), float(any(w in _AGAINST for w in near)), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in tuple(".-/:=#_") and before != ""), float(after[:1] in tuple("-/:=#_") and after != ""),
        float(len(set(digits))), float(tail.isalpha() and 2 <= len(tail) <= 12), float(span[:1] == "+"),
    ]


def _sentences(n: int) -> Iterator[tuple[str, set[tuple[int, int, int]]]]:
    """Made sentences and the (start, kind, end) that are personal data in them."""
    r = random.Random(20240)
    syllables = "an ti er or the be ra lo mi que de en ion sch ung eau oi ka su no".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(good: bool) -> str:
        body = r.choice("3456") + digits(r.choice((11, 12, 13, 14, 14, 14, 15, 17)))
        check = next(c for c in "0123456789" if luhn(body + c))
        whole = body + (check if good else r.choice([c for c in "0123456789" if c != check]))
        sep = r.choice(("", "", " ", "-", "."))
        return sep.join(whole[i : i + 4] for i in range(0, 16, 4)) if sep and len(whole) == 16 else whole

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"+44 {digits(2)} {digits(4)} {digits(4)}", f"+{digits(2)} {a} {b} {c}", f"{a}-{b}-{c}", f"+1.{a}.{b}.{c}"))

    good = {
        0: lambda: r.choice((f"{word()}.{digits(2)}@{word()}{r.randint(1, 9)}.example.com", f"{word()}@{word()}.org", f"{word()} [at] {word()} [dot] com", f"{word()}(at){word()}.net", f"é{word()}@{word()}.fr")),
        1: lambda: r.choice((".".join(str(r.randint(1, 255)) for _ in range(4)), ":".join(f"{r.randrange(65536):x}" for _ in range(8)))),
        2: lambda: card(True),
        3: phone,
    }
    bad = (
        lambda: card(False), lambda: digits(r.randint(12, 19)), lambda: f"{r.choice(_AGAINST)} {digits(3)}-{digits(3)}-{digits(4)}", lambda: f"{r.choice(_AGAINST)} {r.randint(1, 30)}.{r.randint(0, 30)}.{r.randint(0, 30)}.{r.randint(0, 30)}",
        lambda: f"{r.randint(256, 999)}.{r.randint(0, 999)}.{r.randint(0, 999)}.{r.randint(0, 999)}", lambda: f"{digits(4)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"isbn {digits(13)}", lambda: f"{word()}@{word()}..", lambda: f"{word()}@{digits(3)}.", lambda: f"#{digits(3)}.{digits(3)}.{digits(4)}", lambda: digits(4) + "/" + digits(14), lambda: f"{digits(20)}",
    )
    for _ in range(n):
        text, true = word(), set()
        for _ in range(r.randint(1, 4)):
            for _ in range(r.randint(0, 4)):
                text += " " + word()
            text += r.choice((" ", " ", " ", ", ", ": "))
            if r.random() < 0.6:
                kind = r.randrange(4)
                if r.random() < 0.25:
                    text += r.choice(_CUES[KINDS[kind]]) + r.choice((" ", ": "))
                said = good[kind]()
                true.add((len(text), kind, len(text) + len(said)))
                text += said
            else:
                text += r.choice(bad)()
        yield text + r.choice((".", "", " " + word(), ","))  , true


@functools.lru_cache(maxsize=2)
def fitted(n: int = TRAIN_SENTENCES, precision: float = PRECISION) -> tuple[Boosted, tuple[float, ...]]:
    """The trees, and the threshold of each kind from the held-out third of the sentences."""
    x, y, part = [], [], []
    for i, (text, true) in enumerate(_sentences(n)):
        for start, g, end in candidates(text):
            x.append(features(text, start, g, end))
            y.append(float((start, KINDS.index(_GENERATORS[g][0]), end) in true))
            part.append(i % 3)
    x, y, part = np.array(x), np.array(y), np.array(part)
    model = boost(x[part > 0], y[part > 0])
    held = part == 0
    score = model.scores(x[held])
    return model, tuple(precise_threshold(score[x[held, 0] == k], y[held][x[held, 0] == k], precision) for k in range(len(KINDS)))


def added(text: str, base: list[tuple[int, int, int]], model: Boosted, limits: tuple[float, ...]) -> list[tuple[int, int, int]]:
    """The selected spans that no base span of any kind covers, best first among those of a kind that overlap."""
    covered = [(s, e) for s, _, e in base]
    rest = [c for c in candidates(text) if not any(s <= c[0] and c[2] <= e for s, e in covered)] if len(base) < 64 else _outside(candidates(text), base)
    if not rest:
        return []
    rows = sorted(set(rest))
    score = model.scores(np.array([features(text, *c) for c in rows]))
    out: list[tuple[int, int, int]] = []
    taken: dict[int, list[tuple[int, int]]] = {}  # sorted and apart, for each kind
    for i in np.argsort(-score, kind="stable"):
        start, g, end = rows[i]
        kind = KINDS.index(_GENERATORS[g][0])
        if score[i] < limits[kind]:
            continue
        mine = taken.setdefault(kind, [])
        k = bisect.bisect_left(mine, (start, end))
        if not (k and mine[k - 1][1] > start) and not (k < len(mine) and mine[k][0] < end):
            mine.insert(k, (start, end))
            out.append((start, kind, end))
    return out


def _outside(found: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    starts = np.array([s for s, _, _ in base])
    reach = np.maximum.accumulate(np.array([e for _, _, e in base]))
    return [c for c in found if not (k := int(np.searchsorted(starts, c[0], side="right"))) or reach[k - 1] < c[2]]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _may_hold(texts: pa.Array) -> list[bool]:
    """Which texts hold a digit, an at sign or an opening bracket: no pattern and no generator matches without one."""
    raw, at = utf8(texts)
    seen = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_TRIGGER[raw], out=seen[1:])
    return (seen[at[1:]] > seen[at[:-1]]).tolist()


def detect(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Base counts, digest of the base spans and all spans of every document; one pass, no shuffle."""
    model, limits = fitted()
    schema = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for start in range(0, batch.num_rows, 256):
                piece = batch.column(1).slice(start, 256)
                for doc, said, may in zip(batch.column(0).slice(start, 256).to_pylist(), piece.to_pylist(), _may_hold(piece), strict=True):
                    said = said if may else ""
                    base = base_spans(said or "")
                    more = added(said, base, model, limits) if said else []
                    n = [sum(k == i for _, k, _ in base) for i in range(4)] if base else (0, 0, 0, 0)
                    rows.append((doc, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined([*base, *more]), len(more)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(docs[doc_id].cast("long"), docs[text]).mapInArrow(run, SCHEMA)
