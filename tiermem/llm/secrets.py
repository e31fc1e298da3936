"""Secret scans: generators propose candidates, a random forest trained on labelled findings removes false positives.

Candidates: known prefixes, values assigned to credential-like names, and every run of 16 or more token characters. Neither a name, a run nor a
value is too long. The forest sees the candidate's length, its character transitions, how much of it dictionary words cover, the path (source) it
stands in, and the neighbouring words.

The dictionary is the words found in the most documents (LEXICON at most), counted over all of them, and a few words of configuration files. The forest is
trained on the driver on at most TRAIN_FINDINGS made findings with known labels (fixed seed; the harmless ones partly made of the dictionary's
words), whatever the size of the corpus. The threshold is the lowest that meets PRECISION on findings held out; it has no other bound.

Defined cases: null and empty texts have no candidates; a null path counts as empty; texts of any length are scanned whole, in time in proportion to
it; of kept candidates that overlap the best score stays, then the first; rows that repeat are judged each; an empty table gives no rows; other
columns are ignored. Offsets are code points, ends exclusive."""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize, runs, utf8
from .trees import Forest, forest, precise_threshold

#: Made findings that the forest is trained and its threshold calibrated on.
TRAIN_FINDINGS = 9000
PRECISION = 0.99
CONTEXT = 32
#: Words of the dictionary at most: those found in the most documents. So what is sent to tasks is bounded at any scale.
LEXICON, STEP = 20_000, 64
#: Letters of a dictionary word.
SHORTEST, LONGEST = 4, 24
#: Candidates that are scored at once.
SCORED = 8192
SCHEMA = "doc_id long, n_candidates long, n_secrets long, spans string, scores string, secrets_sha256 string"
#: Shortest run of token characters that is a candidate, and the shortest match of a known shape.
RUN, KNOWN_RUN = 16, 15
# fixed values: shapes that issuers document publicly
_KNOWN = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35}|-----BEGIN [A-Z ]*+PRIVATE KEY-----)")
_OPERATOR = re.compile("[:=]")
_VALUE = re.compile(r"\s*+[\"']?+([^\s\"'<>,;]{6,}+)")
_NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
_NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "accesskey", "auth", "credential")
_LONG = re.compile(r"[A-Za-z0-9+/_-]{%d,}+={0,2}+" % RUN)
_CREDENTIAL = ("password", "passwd", "pwd", "secret", "token", "key", "auth", "credential", "private", "bearer")
_HARMLESS = ("sha", "md5", "commit", "checksum", "digest", "uuid", "hash", "etag", "revision", "isbn", "image", "http", "https", "url", "example", "version")
#: Words of configuration files, besides those that the corpus gives.
_WORDS = "the and for with from this that have your example test user name value change secret password token default none null true false string here dummy sample placeholder config service account data base file path home index page image media content admin root local host public private main".split()
_DEV_PATHS = ("src", "code", "git", "repo", "env", "conf", "paste", "log")
_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[list((_NAME + "+/").encode())] = True
_OPERATORS = np.zeros(256, dtype=bool)
_OPERATORS[list(b"=:")] = True


def lexicon(docs: DataFrame, text: str = "text", size: int = LEXICON) -> list[str]:
    """The words (runs of SHORTEST to LONGEST letters, lowered) that the most documents hold, counted over whole texts of all documents: those in at least
    so many documents that no more than size words are left. That number is sought in steps of a STEP-th of a doubling, so only those words leave the tasks."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}]+"), lambda w: F.length(w).between(SHORTEST, LONGEST)))
    found = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).withColumn("step", F.floor(F.log2("n") * STEP).cast("int"))
    found = materialize(found, "lexicon")
    least, left = 0, size
    for r in found.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.col("step").desc()).collect():  # 64 * STEP rows at most
        if r.n > left:
            least = r.step + 1
            break
        left -= r.n
    out = sorted(r.w for r in found.where(F.col("step") >= least).select("w").collect())
    drop_materialized(found)
    return out


class Dictionary:
    """Which part of a string words cover."""

    def __init__(self, words: tuple[str, ...]) -> None:
        self.automaton = ahocorasick.Automaton()
        for w in {*words, *(w for w in _WORDS if len(w) >= SHORTEST)}:
            self.automaton.add_word(w, len(w))
        self.automaton.make_automaton()

    def share(self, low: str) -> float:
        covered, upto = 0, 0
        for end, n in sorted((e + 1, n) for e, n in self.automaton.iter(low)):
            # matches come by their ends; a longer one may begin before what is covered, but never covers a gap twice
            covered += end - max(upto, end - n) if end > upto else 0
            upto = max(upto, end)
        return covered / len(low)


def _kind(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def _assigned(text: str) -> Iterator[tuple[int, int]]:
    """Spans of values assigned to names that hold a credential's word. No character is looked at from more than two operators."""
    done = 0
    m = _OPERATOR.search(text)
    while m:
        head = text[done : m.start()].rstrip()
        if head[-1:] in ("'", '"'):
            head = head[:-1]
        name = head[len(head.rstrip(_NAME)) :].lower().replace("_", "").replace("-", "")
        done = m.end()
        if any(n in name for n in _NAMES):
            v = _VALUE.match(text, done)
            if v:
                yield v.span(1)
                done = v.end()
        m = _OPERATOR.search(text, done)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, generator), the first generator's where two propose the same span."""
    out: dict[tuple[int, int], int] = {}
    for g, spans in enumerate(((m.span() for m in _KNOWN.finditer(text)), _assigned(text), (m.span() for m in _LONG.finditer(text)))):
        for span in spans:
            out.setdefault(span, g)
    return sorted((s, e, g) for (s, e), g in out.items())


def may_hold(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts hold an operator, a long enough run of token characters or five dashes: no generator matches without one."""
    seen = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_OPERATORS[raw], out=seen[1:])
    may = seen[at[1:]] > seen[at[:-1]]
    for marked, least in ((_TOKEN[raw], KNOWN_RUN), (raw == 0x2D, 5)):
        first, end, row = runs(marked, at)
        may[row[end - first >= least]] = True
    return may


def features(text: str, start: int, end: int, g: int, path: str, words: Dictionary) -> list[float]:
    span = text[start:end]
    kinds = [_kind(c) for c in span]
    n = len(span)
    moves = [0] * 16
    for a, b in zip(kinds, kinds[1:], strict=False):
        moves[4 * a + b] += 1
    counts: dict[str, int] = {}
    for c in span:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    low = span.lower()
    covered = words.share(low)
    vowels = sum(c in "aeiou" for c in low) / n
    hexa = all(c in "0123456789abcdef" for c in low)
    before, after = re.findall(r"[a-z0-9]+", text[max(0, start - CONTEXT) : start].lower())[-4:], re.findall(r"[a-z]+", text[end : end + CONTEXT].lower())[:2]
    where = path.lower()
    return [
        float(g), float(n), entropy, covered, vowels, float(hexa), kinds.count(0) / n, kinds.count(1) / n, kinds.count(2) / n, kinds.count(3) / n,
        sum(moves[4 * a + b] for a in range(4) for b in range(4) if a != b) / max(1, n - 1), moves[2 * 4] / max(1, n - 1), moves[2] / max(1, n - 1), moves[1] / max(1, n - 1), moves[4] / max(1, n - 1),
        float(any(c in w for c in _CREDENTIAL for w in before)), float(any(w.startswith(c) for c in _HARMLESS for w in before)), float(any(c in w for c in _CREDENTIAL for w in after)),
        float(text[max(0, start - 1) : start] in ("\"", "'", "=", ":")), float(any(p in where for p in _DEV_PATHS)), float(len(counts)), float(n in (32, 40, 64) and hexa), float("-" in span and n == 36), float(low.endswith((".com", ".org", ".html", ".png", ".jpg"))),
    ]


def _findings(n: int, known: tuple[str, ...] = ()) -> Iterator[tuple[str, str, dict[tuple[int, int], bool]]]:
    """Made texts with their path, and whether each planted string is a secret. Harmless ones hold made words and words of the dictionary."""
    r = random.Random(31)
    syllables = "an ti er or the be ra lo mi que de en ion sch ung eau oi ka su no".split()
    some = [w for w in known if w.isascii()] or list(_WORDS)
    made = lambda a=1, b=4: "".join(r.choice(syllables) for _ in range(r.randint(a, b)))
    word = lambda a=1, b=4: made(a, b) if r.random() < 0.5 else r.choice(some)
    of = lambda abc, k: "".join(r.choice(abc) for _ in range(k))
    digits, hexa, upper = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    letters = "abcdefghijklmnopqrstuvwxyz"
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + letters + digits
    name = lambda: r.choice(("password", "token", "secret", "api_key", "auth_token", "access-key", "passwd", "DB_PASSWORD", "credentials_of_" + made()))
    other = lambda: r.choice(("color", "session", "image", "digest", "build", "ref", "etag", "sha256", "id", made()))
    gap = lambda: r.choice(("=", " = ", ": ", '="', ' = "'))
    good = (
        lambda: ("", "AKIA" + of(upper, 16)), lambda: ("", "ghp_" + of(alnum, 36)), lambda: (name() + gap(), of(hexa, r.choice((16, 18, 20, 32, 40, 64)))), lambda: (name() + gap(), of(alnum + "!$%+/", r.randint(10, 64))),
        lambda: (r.choice(("bearer ", "key ", "secret ", "auth ")), of(alnum, r.randint(24, 48))), lambda: (name() + gap(), of(hexa, r.randint(16, 40))), lambda: (name() + gap(), of(letters, r.randint(24, 60))),
        lambda: (name() + gap(), of(letters, r.randint(20, 50)) + of(digits, 3)), lambda: (r.choice(("bearer ", "key ", "secret ", "auth ")), of(letters, r.randint(24, 48))), lambda: (r.choice(("key ", "secret ")), of(hexa, r.choice((32, 40, 64)))),
    )
    bad = (
        lambda: (name() + gap(), word() + r.choice(("", "_", "-")) + word(2, 4)), lambda: (name() + gap(), made(3, 6)), lambda: (name() + ": ", word(3, 5)), lambda: (r.choice(("sha1 ", "sha256:", "commit ", "md5 ", "checksum ", "etag ")), of(hexa, r.choice((32, 40, 64)))),
        lambda: ("", "-".join(of(hexa, k) for k in (8, 4, 4, 4, 12))), lambda: ("", "/".join(word() for _ in range(5)) + "/" + of(digits, 4)), lambda: ("", of(digits, r.randint(16, 30))), lambda: ("", "-".join(word() for _ in range(5)) + "-" + of(digits, 3)), lambda: (name() + gap(), "example" + of(digits, 3)), lambda: ("", made(6, 12) + of(digits, 2)),
        lambda: ("", made(6, 14)), lambda: ("", made(6, 14).capitalize()), lambda: ("", made(6, 14).upper()), lambda: ("", "".join(r.choice(some) for _ in range(r.randint(2, 5))).capitalize()), lambda: (r.choice(("the ", "a ", "key ", "secret ", "auth ")), made(6, 12).capitalize()), lambda: ("", made(4, 6) + "-" + made(3, 6).capitalize()), lambda: ("", "_".join(word() for _ in range(4))), lambda: (other() + gap(), of(hexa, r.choice((32, 40, 64)))), lambda: (name() + gap(), of(digits, r.randint(6, 14))), lambda: ("", "-" * r.randint(16, 60)), lambda: ("", r.choice("=_/+-x0") * r.randint(16, 40)),
        lambda: (name() + gap(), "".join(word(2, 4) for _ in range(r.randint(2, 5)))), lambda: (name() + gap(), r.choice("x*.#0") * r.randint(6, 20)), lambda: (name() + gap(), "${" + made() + "_" + made() + "}"), lambda: (name() + gap(), made() + "." + made() + "(" + made() + ")"),
    )
    for _ in range(n):
        text, true = word(), {}
        for _ in range(r.randint(1, 5)):
            text += " " + word()
        good_one = r.random() < 0.5
        lead, value = r.choice(good if good_one else bad)()
        text += " " + lead
        true[len(text), len(text) + len(value)] = good_one
        text += value + (lead[-1:] if lead[-1:] == '"' else "") + r.choice(("", " ", ", ", ".\n")) + " " + word() + " " + word()
        yield text, r.choice(("src0", "src7", "web/page", "src/app.py", "conf/env", "news/article")), true


def labelled(n: int, known: tuple[str, ...], skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and places of the candidates of made findings skip to n."""
    x, y, place = [], [], []
    words = Dictionary(known)
    for i, (text, path, true) in enumerate(_findings(n, known)):
        for s, e, g in candidates(text) if i >= skip else ():
            label = next((v for (a, b), v in true.items() if s < b and a < e), None)
            if label is not None:
                x.append(features(text, s, e, g, path, words))
                y.append(float(label))
                place.append(i)
    return np.array(x), np.array(y), np.array(place)


@functools.lru_cache(maxsize=4)
def fitted(known: tuple[str, ...] = (), n: int = TRAIN_FINDINGS, precision: float = PRECISION) -> tuple[Forest, float]:
    """The forest, and the threshold from the third of the findings that it was not trained on."""
    x, y, place = labelled(n, known)
    held = place % 3 == 0
    model = forest(x[~held], y[~held], depth=12)
    return model, precise_threshold(model.scores(x[held]), y[held], precision)


def apart(found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Of spans (start, end, score) that overlap the best score, then the first; in order of start."""
    out: list[tuple[int, int, float]] = []
    for s, e, p in sorted(found, key=lambda f: (-f[2], f[0], f[1])):
        k = bisect.bisect_left(out, (s, e, p))
        if not (k and out[k - 1][1] > s) and not (k < len(out) and out[k][0] < e):
            out.insert(k, (s, e, p))
    return out


def scan(docs: DataFrame, text: str = "text", path: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row for each document: candidates found, those the forest keeps (spans start:end and scores), and the digest of their texts."""
    known = tuple(lexicon(docs, text))  # LEXICON words at most
    model, limit = fitted(known)
    sent = docs.sparkSession.sparkContext.broadcast(known)
    schema = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in SCHEMA.split(", ")])

    def judged(rows: list[tuple], wait: list[tuple[int, int, int]], values: list[str], feats: list[list[float]]) -> pa.RecordBatch:
        kept: dict[int, list[tuple[int, int, float]]] = {}
        said: dict[tuple[int, int, int], str] = {}
        if feats:
            for (k, s, e), value, p in zip(wait, values, model.scores(np.array(feats)).tolist(), strict=True):
                if p >= limit:
                    kept.setdefault(k, []).append((s, e, p))
                    said[k, s, e] = value
        full = []
        for k, row in enumerate(rows):
            f = apart(kept[k]) if k in kept else []
            full.append((*row, len(f), ",".join(f"{s}:{e}" for s, e, _ in f), ",".join(f"{p:.3f}" for *_, p in f), hashlib.sha256("\n".join(said[k, s, e] for s, e, _ in f).encode()).hexdigest()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*full, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Dictionary(sent.value)
        rows, wait, values, feats = [], [], [], []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                ids, texts, paths = (batch.column(i).slice(start, 256) for i in range(3))
                may = may_hold(*utf8(texts))
                for k, (doc, said, where) in enumerate(zip(ids.to_pylist(), texts.to_pylist(), paths.to_pylist(), strict=True)):
                    found = candidates(said) if said and may[k] else []
                    for s, e, g in found:
                        wait.append((len(rows), s, e))
                        values.append(said[s:e])
                        feats.append(features(said, s, e, g, where or "", words))
                    rows.append((doc, len(found)))
                if len(feats) >= SCORED or len(rows) >= SCORED:
                    yield judged(rows, wait, values, feats)
                    rows, wait, values, feats = [], [], [], []
        if rows:
            yield judged(rows, wait, values, feats)

    return docs.select(docs[doc_id].cast("long"), docs[text], docs[path].cast("string")).mapInArrow(run, SCHEMA)
