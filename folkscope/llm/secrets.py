"""Secret scan: fixed patterns, and values in a credential context that would be costly to guess.

A value's guess cost is the least, over all ways to cut it into segments, of the summed
log10 guesses of its segments: dictionary words, dates, repeats, keyboard walks and
brute-force spans (Wheeler, "zxcvbn: low-budget password strength estimation", 2016).
A value that no cheap cut explains is a secret.

One pass over the documents without a shuffle. Work is linear in the text. A value is cut
in time proportional to its length, but for a logarithm where many of its spans repeat.

Defined cases: a null or empty text has no spans; every row gives a row, also repeated
ones; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folkscope.llm.registry import read_table, register

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ASSIGN_VALUE_CHARS = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_CHARS = 20
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is matched whole, so its length can stand in the pattern

#: A name that holds a credential word, up to two further words, a separator or "is", and a value up to white space or
#: a quote. A name is entered at its begin and taken whole, so that the search stays linear.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|auth|private|signing)[_-]?key))"""
    r"""[A-Za-z0-9_-]*+["']?(?:[\x20\t]++(?!is\b)[A-Za-z0-9_-]++["']?){0,2}[\x20\t]*+(?:=>|[:=]|\bis\b)[\x20\t]*+["'`]?([^\s"'`<>]{6,})""",
    re.ASCII | re.IGNORECASE,
)
CONTEXT_HINTS = (b"pass", b"pwd", b"secret", b"token", b"credential", b"key")

# Rows of the usual English keyboard.
KEYBOARD_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
# Passwords at the head of every published list.
COMMON_PASSWORDS = (
    "password 123456 qwerty letmein admin welcome monkey dragon football baseball master sunshine iloveyou "
    "princess shadow superman trustno1 changeme default secret login abc123 starwars hello freedom whatever"
).split()
# Characters that stand for letters.
LEET = str.maketrans("@4310!$57", "aaeloisst")

DATE = re.compile(
    r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d)"
)
YEAR = re.compile(r"(?:19|20)\d\d")

LOG_SEGMENT = math.log10(2)  # what a further segment adds, for the order of segments
LOG_DATE = math.log10(365 * 119)
LOG_YEAR = math.log10(119)
MAX_WORD_CHARS = 24
SECRET_LOG10_GUESSES = 10.0


def neighbours() -> dict[str, str]:
    """Each key with the keys that touch it on the usual staggered keyboard."""
    place = {c: (x + 0.5 * y, y) for y, row in enumerate(KEYBOARD_ROWS) for x, c in enumerate(row)}
    return {
        a: "".join(b for b, (u, v) in place.items() if a != b and abs(v - y) <= 1 and abs(u - x) <= 1)
        for a, (x, y) in place.items()
    }


def vocabulary(path: str) -> dict[str, float]:
    """log10 of each word's rank: common passwords first, then whole words of a tokenizer's vocabulary in its order."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["model"]["vocab"]
    whole = (t.removesuffix("</w>") for t, _ in sorted(tokens.items(), key=lambda x: x[1]) if t.endswith("</w>"))
    words = dict.fromkeys([*COMMON_PASSWORDS, *(w for w in whole if 3 <= len(w) <= MAX_WORD_CHARS and w.isalpha())])
    return {w: math.log10(rank) for rank, w in enumerate(words, 1)}


def segments_from(value: str, words: dict[str, float], keys: dict[str, str]) -> list[list[tuple[int, float, str]]]:
    """For each position, the segments that begin there: end, log10 guesses, kind."""
    lower, n = value.lower(), len(value)
    plain = lower.translate(LEET)
    if len(lower) != n:  # a letter whose lower case is longer
        lower = plain = value
    found: list[list[tuple[int, float, str]]] = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i + 3, min(n, i + MAX_WORD_CHARS) + 1):
            rank = words.get(lower[i:j])
            extra = 0.0
            if rank is None and (rank := words.get(plain[i:j])) is not None:
                extra = math.log10(2)
            if rank is not None:
                part = value[i:j]
                upper = sum(c.isupper() for c in part)
                if upper and (upper == len(part) or (upper == 1 and part[0].isupper())):
                    extra += math.log10(2)
                elif upper:
                    extra += math.log10(sum(math.comb(len(part), k) for k in range(1, min(upper, len(part) - upper) + 1)))
                found[i].append((j, rank + extra, "word"))
        if m := DATE.match(value, i):
            found[i].append((m.end(), LOG_DATE + (math.log10(4) if m[1] or m[2] else 0), "date"))
        if m := YEAR.match(value, i):
            found[i].append((m.end(), LOG_YEAR, "date"))
    i = 0
    while i < n - 2:  # keyboard walks, each run whole and from each of its starts
        j, turns, last = i + 1, 0, None
        while j < n and lower[j] in keys.get(lower[j - 1], ""):
            step = (ord(lower[j]) > ord(lower[j - 1]), keys[lower[j - 1]].index(lower[j]))
            turns, last = turns + (step != last), step
            j += 1
        if j - i >= 3:
            found[i].append((j, math.log10(47) + math.log10(j - i) + turns * math.log10(5), "walk"))
        i = max(j - 1, i + 1)
    return found


class Repeats:
    """How far a span of a text goes on repeating, by hashes of its beginnings and a search by halves.

    The last run found is kept: within a run of period p every span of a multiple of p
    goes on to the end of that run, so a long run is searched once.
    """

    MODULUS = (1 << 61) - 1
    BASE = 0x1F3A5C7E9B2D4F61 % MODULUS

    def __init__(self, value: str):
        self.value = value
        self.sums: list[int] = []
        self.powers: list[int] = []
        self.run = (0, 0, 1)  # begin, end, period

    def same(self, a: int, b: int, size: int) -> bool:
        if not self.sums:
            self.sums, self.powers, total, power = [0], [1], 0, 1
            for c in self.value:
                total, power = (total * self.BASE + ord(c) + 1) % self.MODULUS, power * self.BASE % self.MODULUS
                self.sums.append(total)
                self.powers.append(power)
        sums, scale = self.sums, self.powers[size]
        return (sums[a + size] - sums[a] * scale - sums[b + size] + sums[b] * scale) % self.MODULUS == 0

    def times_after(self, begin: int, end: int) -> int:
        """How often value[begin:end] follows itself from ``end`` on."""
        value, unit = self.value, end - begin
        if end + unit > len(value) or value[begin] != value[end]:
            return 0
        run_begin, run_end, period = self.run
        if not (run_begin <= begin and end <= run_end and unit % period == 0):
            if not self.same(begin, end, unit):
                return 0
            low, high = unit, len(value) - end  # the length on which the text agrees with itself, moved by unit
            while low < high:
                middle = (low + high + 1) // 2
                if self.same(begin, end, middle):
                    low = middle
                else:
                    high = middle - 1
            self.run = begin, end + low, unit
            run_end = end + low
        return (run_end - end) // unit


def guess_cost(value: str, words: dict[str, float], keys: dict[str, str]) -> tuple[float, list[tuple[int, int, str]]]:
    """The least log10 guesses over all segmentations, and the cut that has it.

    ``best[i]`` is the least cost of the first i characters. A brute-force span costs the
    same for each further character, so one running minimum stands for all its starts.
    """
    n = len(value)
    if n == 0:
        return 0.0, []
    classes = (str.isdigit, 10), (str.islower, 26), (str.isupper, 26)
    letters = sum(size for test, size in classes if any(map(test, value)))
    if any(not c.isalnum() for c in value):
        letters += 33
    if not value.isascii():
        letters += 100
    step = math.log10(letters)
    starts = segments_from(value, words, keys)
    best, back = [0.0] + [math.inf] * n, [(0, "")] * (n + 1)
    brute, brute_from = math.inf, 0
    repeats = Repeats(value)
    for i in range(n):
        here = best[i] + (LOG_SEGMENT if i else 0)
        if here < brute:
            brute, brute_from = here, i
        brute += step
        if brute < best[i + 1]:
            best[i + 1], back[i + 1] = brute, (brute_from, "brute")
        for end, cost, kind in starts[i]:
            if here + cost < best[end]:
                best[end], back[end] = here + cost, (i, kind)
        # A repeat: what ends at i once more, as often as it goes on.
        begin, kind = back[i]
        if i and (times := repeats.times_after(begin, i)):
            cost, end = best[i] + math.log10(times + 1), i + times * (i - begin)
            if cost < best[end]:
                best[end], back[end] = cost, (begin, "repeat")
        elif i and value[i] == value[i - 1] and (i < 2 or value[i - 2] != value[i]):  # a repeated character
            end = i
            while end < n and value[end] == value[i]:
                end += 1
            cost = best[i - 1] + LOG_SEGMENT + step + math.log10(end - i + 1)
            if cost < best[end]:
                best[end], back[end] = cost, (i - 1, "repeat")
    cut, i = [], n
    while i > 0:
        begin, kind = back[i]
        cut.append((begin, i, kind))
        i = begin
    return best[n], cut[::-1]


def base_spans(text: str, lower: bytes) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns. ``lower``: the text's bytes, A-Z lowered; spares most texts a search."""
    spans = []
    if any(word in lower for word in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")):
        spans += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE_CHARS]
    if b"akia" in lower:
        spans += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    spans += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return spans


def guess_spans(text: str, lower: bytes, taken: list, words, keys, threshold: float) -> list[tuple[int, str, int, float]]:
    """Costly values in a credential context, apart from those that lie within a span already found.

    Contexts come in the order of the text, so one pass over the spans by start knows how far
    those that begin before a value reach.
    """
    found, before, at, reach = [], sorted((a, b) for a, _, b in taken), 0, -1
    if any(hint in lower for hint in CONTEXT_HINTS):
        for m in CONTEXT.finditer(text):
            start, value = m.start(1), m[1].rstrip(".,;:!?)]}")
            end = start + len(value)
            while at < len(before) and before[at][0] <= start:
                reach, at = max(reach, before[at][1]), at + 1
            if len(value) < 6 or end <= reach:
                continue
            cost, _ = guess_cost(value, words, keys)
            if cost >= threshold:
                found.append((start, "guess", end, cost))
    return found


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
    ("n_guess", pa.int64()), ("found", pa.list_(pa.struct([
        ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()),
        ("log10_guesses", pa.float64()),
    ]))),
])


def scan_secrets(docs: DataFrame, vocabulary_path: str | None = None, threshold: float = SECRET_LOG10_GUESSES) -> DataFrame:
    """Spans of secrets in each text, in code points, with their value and guess cost.

    ``docs`` has ``doc_id`` and ``text``. ``vocabulary_path``: a tokenizer file with ranked
    words; ``threshold``: log10 guesses from which a value in a credential context counts.
    Returns doc_id, the count of each kind, and ``found``, ordered by start and kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        words, keys = vocabulary(path), neighbours()
        order = {kind: k for k, kind in enumerate(KINDS)}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                lower = text.encode().lower()
                base = base_spans(text, lower)
                spans = [(*s, None) for s in base] + guess_spans(text, lower, base, words, keys, threshold)
                spans.sort(key=lambda s: (s[0], order[s[1]]))
                found = []
                for start, kind, end, cost in spans:
                    value = text[start:end]
                    if cost is None:
                        m = ASSIGN.fullmatch(value) if kind == "assign" else None
                        cost = guess_cost(m[2] if m else value, words, keys)[0]
                    found.append({"kind": kind, "start": start, "end": end, "value": value, "log10_guesses": cost})
                kinds = [s[1] for s in spans]
                counts = {f"n_{kind}": kinds.count(kind) for kind in KINDS}
                rows.append({"doc_id": doc_id, "found": found} | counts)
            yield pa.RecordBatch.from_pylist(rows, RESULT)

    kinds = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long"
    found = "found array<struct<kind string, start long, end long, value string, log10_guesses double>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"{kinds}, {found}")


def joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@register("op1_secret_scan")
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base digest, all spans and the greatest guess cost among them (null without spans), per document."""
    found = scan_secrets(read_table(spark, folder, "documents"))
    base = F.filter("found", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        "n_guess",
        F.array_max(F.transform("found", lambda s: s["log10_guesses"])).alias("max_log10_guesses"),
    )


def digest_of(spans: list[tuple[int, str, int]]) -> str:
    """The digest of base spans, as the query gives it."""
    order = {kind: k for k, kind in enumerate(KINDS)}
    ordered = sorted(spans, key=lambda s: (s[0], order[s[1]]))
    return hashlib.sha256(",".join(f"{kind}:{start}:{end}" for start, kind, end in ordered).encode()).hexdigest()
