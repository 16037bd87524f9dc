"""Secret scan: three fixed patterns, and sliding-window Shannon entropy over candidate strings.

Candidates are runs of 20 or more of ``A-Za-z0-9+/_=.-``. A window slides over each; the counts of
its characters change by one in and one out, and the entropy sum follows by difference. A candidate
is a secret where a window of its character class (hex, alphanumeric, base64) reaches the class's
threshold, unless the allow list knows it. What a pattern has taken is cut out of a run first. A run
that is no secret as a whole is cut into its alphanumeric runs, and these into their hex runs; each
is judged by its own class, and the allow list holds for that part alone. Fillers and placeholder words
(``0000``, ``abcdef``, ``example``) explain only their own characters: they are taken out, and the rest
is judged, down to ``REST_LEAST`` characters.

Defined cases: a null text counts as empty and gives counts of 0, the digest of the empty string and
an empty span list. Null ids pass through; repeated rows are scanned each. Texts of any length are
scanned whole. An empty table gives an empty result. Columns other than the keys and the text are
not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The three base patterns and their least lengths.
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")
#: Every match of ASSIGN holds one of these in lower case.
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

CANDIDATE_LEAST, REST_LEAST = 20, 16


@dataclass(frozen=True)
class CharClass:
    """Strings of ``chars`` only are of this class; ``bits`` is the entropy a window of ``window`` must reach; shorter strings are one window, with bits in proportion."""

    name: str
    pattern: re.Pattern
    window: int
    bits: float
    mixed: int  #: how many of lower case, upper case and digits must occur in the window


CLASSES = (
    CharClass("hex", re.compile(r"[0-9a-fA-F]+"), 20, 3.0, 1),
    CharClass("alphanumeric", re.compile(r"[A-Za-z0-9]+"), 20, 3.6, 2),
    CharClass("base64", re.compile(r"[A-Za-z0-9+/_=.-]+"), 24, 3.9, 2),
)
#: The alternatives of a part exclude each other, so that a match that fails takes time in proportion to the length.
#: Not secrets: UUIDs, dotted or dashed words (numbered ones too), dates and numbers, file and host names, placeholders.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"[A-Za-z]{1,15}(?:[-_./=+][A-Za-z]{0,15})*"),
    re.compile(r"(?:[A-Z]?[a-z]{0,14}|[A-Z]{2,15})[0-9]{0,4}(?:[-_./=+](?:[A-Z]?[a-z]{0,14}|[A-Z]{2,15})[0-9]{0,4})*"),
    re.compile(r"[0-9]+(?:[-_./=+][0-9]*)*"),
    re.compile(r".*\.(?:com|org|net|html?|php|png|jpe?g|gif|css|js|py|pdf|txt|json|xml)", re.IGNORECASE),
)
FILLERS = re.compile(r"example|placeholder|changeme|dummy|x{4,}|0{4,}|1234567(?:89?0?)?|abcdef", re.IGNORECASE)
_SUM = [0.0] + [n * math.log2(n) for n in range(1, 65)]


def windows_peak(text: str, window: int, mixed: int) -> float:
    """The largest entropy in bits of a window of ``text``; windows with fewer character groups count 0."""
    counts: dict[str, int] = {}
    groups = [0, 0, 0, 0]
    total, peak = 0.0, 0.0
    for k, new in enumerate(text):
        n = counts.get(new, 0)
        counts[new] = n + 1
        total += _SUM[n + 1] - _SUM[n]
        groups[0 if new.islower() else 1 if new.isupper() else 2 if new.isdigit() else 3] += 1
        if k >= window:
            old = text[k - window]
            n = counts[old]
            counts[old] = n - 1
            total += _SUM[n - 1] - _SUM[n]
            groups[0 if old.islower() else 1 if old.isupper() else 2 if old.isdigit() else 3] -= 1
        if k >= window - 1 and (groups[0] > 0) + (groups[1] > 0) + (groups[2] > 0) >= mixed:
            peak = max(peak, math.log2(window) - total / window)
    return peak


def judged_random(candidate: str) -> bool:
    """Whether a window of the candidate's class reaches the class's entropy and no allow rule knows it."""
    if len(candidate) < CANDIDATE_LEAST or candidate.isalpha() and (candidate.islower() or candidate[1:].islower()):
        return False
    if any(rule.fullmatch(candidate) for rule in ALLOWED):
        return False
    rest = FILLERS.sub("", candidate)
    if len(rest) < len(candidate) and (len(rest) < REST_LEAST or any(rule.fullmatch(rest) for rule in ALLOWED)):
        return False
    kind = next(c for c in CLASSES if c.pattern.fullmatch(rest))
    window = min(kind.window, len(rest))
    return windows_peak(rest, window, kind.mixed) >= kind.bits * math.log2(window) / math.log2(kind.window)


_known = lru_cache(maxsize=50_000)(judged_random)


def is_random(candidate: str) -> bool:
    """``judged_random``; verdicts on candidates of up to 128 characters are kept."""
    return _known(candidate) if len(candidate) <= 128 else judged_random(candidate)


def random_parts(run: str) -> list[tuple[int, int]]:
    """Spans of the secrets in ``run``: the run itself, or else the random ones of its runs of the narrower classes."""
    found, rest = [], [(0, len(run))]
    for kind in reversed(CLASSES):
        left = []
        for a, b in rest:
            for m in kind.pattern.finditer(run, a, b):
                if m.end() - m.start() >= CANDIDATE_LEAST:
                    (found if is_random(m[0]) else left).append(m.span())
        rest = left
    return sorted(found)


def outside(start: int, end: int, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a span that no span of ``taken`` (sorted) holds."""
    for a, b, _ in taken:
        if a < end and b > start:
            if a > start:
                yield start, a
            start = max(start, b)
    if start < end:
        yield start, end


def _class_of(chars: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[np.frombuffer(chars.encode(), np.uint8)] = True
    return found


_HEX = _class_of("0123456789abcdef")
_LONG = _class_of("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-")


def runs(raw: np.ndarray, chars: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``chars`` with ``least`` bytes or more."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = chars[raw]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - start >= least
    return start[long], end[long]


def base_spans(text: str, raw: bytes, hex_runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the three patterns in code points; ``hex_runs`` are byte offsets."""
    found = []
    low = raw.lower()
    if any(hint in low for hint in ASSIGN_HINTS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return found + [(a, b, 2) for a, b in in_code_points(text, raw, hex_runs)]


def in_code_points(text: str, raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans of ASCII strings as code-point spans."""
    if len(text) == len(raw) or not spans:
        return spans
    out, at, points = [], 0, 0
    for start, end in spans:
        points += len(raw[at:start].decode("utf-8", "surrogatepass"))
        out.append((points, points + end - start))
        at, points = end, points + end - start
    return out


def scan_batch(texts: list[str | None]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Per text: base spans, and entropy spans of what they leave."""
    texts = [t or "" for t in texts]
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) + 1 for r in raws], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    whole = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    by_doc: list[dict[int, list[tuple[int, int]]]] = [{} for _ in texts]
    for kind, chars, least in ((2, _HEX, HEX_LEAST), (3, _LONG, CANDIDATE_LEAST)):
        a, b = runs(whole, chars, least)
        docs = np.searchsorted(starts, a, side="right") - 1
        for d, x, y in zip(docs.tolist(), (a - starts[docs]).tolist(), (b - starts[docs]).tolist()):
            by_doc[d].setdefault(kind, []).append((x, y))
    out = []
    for text, raw, own in zip(texts, raws, by_doc):
        base = sorted(base_spans(text, raw, own.get(2, [])))
        free = [part for a, b in in_code_points(text, raw, own.get(3, [])) for part in outside(a, b, base)]
        more = [(a + x, a + y, 3) for a, b in free if b - a >= CANDIDATE_LEAST for x, y in random_parts(text[a:b])]
        out.append((base, more))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def find_secrets(docs: DataFrame, keys: list[str], text_col: str = "text", batch_chars: int = 8_000_000) -> DataFrame:
    """``keys`` with counts per pattern, the digest of the base spans and all spans, in one pass without a shuffle."""
    wanted = docs.select(*keys, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            texts: list[str | None] = []
            size = 0

            def scan() -> None:
                for base, more in scan_batch(texts):
                    kinds = [k for _, _, k in base]
                    digest = hashlib.sha256(joined(base).encode()).hexdigest()
                    rows.append((kinds.count(0), kinds.count(1), kinds.count(2), digest, joined(base + more)))
                texts.clear()

            for text in batch.column(len(keys)).to_pylist():
                texts.append(text)
                size += len(text or "")
                if size > batch_chars:
                    scan()
                    size = 0
            scan()
            names = [*keys, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            made = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made], names=names)

    return wanted.mapInArrow(run, f"{schema}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
