"""Secret scans: stated patterns, and strings that a vocabulary can only spell in very short tokens."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from riskloom.llm.base import with_computed

#: The kinds in their order, the patterns and the least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Every access or hex match and every candidate lies inside such a run.
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Hex digests of common lengths (16, 20, 24, 28, 32, 48 and 64 bytes) and UUIDs are known, not random.
KNOWN = re.compile(
    r"(?<![0-9a-z])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{48}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12})(?![0-9a-z])",
    re.IGNORECASE,
)
#: The least length of a random string, and of the windows that look for one inside a part without separators.
LEAST = 16
PART = re.compile(r"[^/_+=-]+")


def token_counter(path: str) -> Callable[[str], int]:
    """Number of tokens under the byte-pair ranks in a tiktoken file."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coded = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda s: len(coded.encode_ordinary(s))


def words_of(run: str) -> list[str]:
    return [p for p in re.split(r"[/_+=-]+|(?<=[a-z])(?=[A-Z])", run) if p]


def is_identifier(run: str) -> bool:
    """Numbers, or words of three letters and more joined by ``_ - / +``, each with up to four digits."""
    return all(p.isdigit() or re.fullmatch(r"[A-Z]?[a-z]{2,}[0-9]{0,4}|[A-Z]{2,}[0-9]{0,4}", p) for p in words_of(run))


def uncovered(start: int, end: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the spans leave of a stretch, where ``LEAST`` characters and more are left."""
    out = []
    for a, b in sorted(spans):
        if a < end and b > start:
            out.append((start, a))
            start = b
    return [(a, b) for a, b in [*out, (start, end)] if b - a >= LEAST]


def scanner(count_tokens: Callable[[str], int], least_ratio: float = 2.0) -> Callable[[str], list[tuple[str, int, int]]]:
    """Text to its spans ``(kind, start, end)`` in code points, by start, then kind in the stated order.

    The first three kinds are the stated patterns, leftmost and not overlapping within a kind. What they, digests and UUIDs leave of a
    run of token characters is looked at for ``random``: 16 characters and more that have a letter, are no identifier (whose words of
    16 letters and more must pass the ratio, too) and have fewer than ``least_ratio`` characters for each token. That is the whole rest, or else parts of it that are no words (those that
    adjoin together, then each), or else windows of 16 characters inside a part; windows that meet are one span.
    """

    def short_tokens(s: str) -> bool:
        return len(s) < least_ratio * count_tokens(s)

    def is_plain(s: str) -> bool:
        return is_identifier(s) and not any(len(w) >= LEAST and not w.isdigit() and short_tokens(w) for w in words_of(s))

    def is_random(s: str) -> bool:
        return len(s) >= LEAST and any(map(str.isalpha, s)) and not is_plain(s) and short_tokens(s)

    def in_part(s: str, a: int, b: int) -> list[tuple[int, int]]:
        if is_random(s[a:b]):
            return [(a, b)]
        out: list[tuple[int, int]] = []
        if not is_plain(s[a:b]):
            for i in range(a, b - LEAST + 1):
                if out and i + LEAST <= out[-1][1] or not is_random(s[i : i + LEAST]):
                    continue
                out[-1:] = [(out[-1][0], i + LEAST)] if out and i <= out[-1][1] else [*out[-1:], (i, i + LEAST)]
        return out

    def randoms(s: str) -> list[tuple[int, int]]:
        if len(s) < LEAST or is_plain(s):
            return []
        if is_random(s):
            return [(0, len(s))]
        out, stretch = [], []
        for m in [*PART.finditer(s), None]:
            if m and not is_plain(m[0]):
                stretch.append(m.span())
                continue
            if stretch:
                a, b = stretch[0][0], stretch[-1][1]
                out += [(a, b)] if is_random(s[a:b]) else [x for p in stretch for x in in_part(s, *p)]
            stretch = []
        return out

    def scan(text: str) -> list[tuple[str, int, int]]:
        found = []
        low = text.lower()
        if any(w in low for w in WORDS):
            found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        runs = list(RUN.finditer(text))
        for run in runs:
            a, b = run.span()
            for kind, pattern in (("access", ACCESS), ("hex", HEX)):
                found += [(kind, m.start(), m.end()) for m in pattern.finditer(text, a, b)]
        taken = [(a, b) for _, a, b in found]
        for run in runs:
            known = [m.span() for m in KNOWN.finditer(text, *run.span())]
            for a, b in uncovered(*run.span(), taken + known):
                found += [("random", a + x, a + y) for x, y in randoms(text[a:b])]
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))

    return scan


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span (overlapping ones together) replaced by ``[SECRET]``."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, ranks: str, text: str = "text", least_ratio: float = 2.0) -> DataFrame:
    """``docs`` with ``secrets`` (array of kind, start, end) and ``redacted``, the text without them.

    ``ranks`` is the path of a tiktoken vocabulary that every executor can read. A null text has no spans and stays null.
    Columns with those names are replaced; repeated rows are scanned each on its own.
    """

    def make():
        scan = scanner(token_counter(ranks), least_ratio)

        def find(texts):
            spans = [scan(t) if t else [] for t in texts]
            return [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], [redacted(t, s) if s else t for t, s in zip(texts, spans)]

        return find

    return with_computed(docs, text, "secrets array<struct<kind: string, start: bigint, end: bigint>>, redacted string", make)
