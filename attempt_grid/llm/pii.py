"""Personal data: four fixed patterns, extended by a semi-Markov conditional random field.

The patterns alone find the base spans. The random field looks at stretches of text around digits,
at-signs and spelled-out ones ("at" before a name and a dot): every run of up to ``MAX_TOKENS`` tokens is a candidate segment, scored by features
of the whole span (shape, digit groups, checks, cue before it). Dynamic programming over segments
picks boundaries and kinds jointly; a span is added only where its posterior probability is at
least ``LEAST_POSTERIOR`` and no base span overlaps it.

The field is trained on a bounded number of stretches (``max_stretches``) in which the patterns
mark the spans, and on the same stretches with the spans respelled (a phone number without its
plus, a card in groups of four, an address with "at" and "dot", with digits and without).
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import insort
from collections.abc import Iterator
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_chunks

KINDS = ("email", "ip", "card", "phone")
TRIGGER = re.compile(r"[0-9@]")
# the same, or the word "at", also in brackets, before a name and a dot
SPELLED = re.compile(r"[0-9@]|(?<![^\W_])at(?=\s{0,2}[\])]?\s{0,2}(?!(?:the|an?)\s)[A-Za-z0-9-]{1,63}(?:\s{0,2}[\[(]?\s{0,2}\bdot\b|\.[A-Za-z]))(?![^\W_])")
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match starts where a run of digits does
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# what an address goes on with, to its left and to its right
MORE_LEFT = re.compile(r"(?:[.-]|\bdot[\])]?\s{1,2})\Z")
MORE_RIGHT = re.compile(r"(?:\s{1,2}[\[(]?\s{0,2}dot\b[\])]?\s{1,2}|\.)[A-Za-z]")
DOT_FIRST = re.compile(r"[\[(]?dot\b")
DOT_LAST = re.compile(r"\bdot[\])]?\Z")

MAX_TOKENS = 16
LEAST_POSTERIOR = 0.9
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\W_]|[^\w\s]|_")
CUES = {"tel": 3, "phone": 3, "call": 3, "fax": 3, "mobile": 3, "ip": 1, "host": 1, "server": 1,
        "card": 2, "visa": 2, "credit": 2, "mail": 0, "email": 0, "contact": 0}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LEFT:
            start -= 1
        host = EMAIL_HOST.match(text, at + 1)
        if start < at and host:
            yield start, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four patterns by kind, then start; matches that fail are dropped."""
    if not TRIGGER.search(text):
        return []
    found = [("email", a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        # without leading zeros, of which there may be more than int() reads
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(DIGIT.findall(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def _groups(text: str, trigger: re.Pattern) -> Iterator[tuple[int, int]]:
    """(first, last) of triggers less than 48 characters apart, in groups of up to 2,000 characters."""
    first = last = None
    for m in trigger.finditer(text):
        at = m.start()
        if first is not None and (at - last > 48 or at - first > 2000):
            yield first, last
            first = None
        first = at if first is None else first
        last = at
    if first is not None:
        yield first, last


def _tokens_before(text: str, at: int) -> int:
    """Where the MAX_TOKENS tokens before a place start, however long they are."""
    low, size = at, 96
    while low > 0:
        low, size = max(0, at - size), 2 * size
        found = [m.start() for m in TOKEN.finditer(text, low, at)]
        if len(found) > MAX_TOKENS:  # the first one may be cut
            return found[-MAX_TOKENS]
    return 0


def _left_edge(text: str, first: int) -> int:
    at, least = max(0, first - 40), _tokens_before(text, first)
    while at > least:
        if text[at - 1].isspace():
            if not (MORE_LEFT.search(text, max(0, at - 7), at) or DOT_FIRST.match(text, at)):
                break
            while at > least and text[at - 1].isspace():
                at -= 1
        else:
            at -= 1
    return at


def _right_edge(text: str, last: int) -> int:
    most = last + 1
    for m in islice(TOKEN.finditer(text, last), MAX_TOKENS):
        most = m.end()
    at = min(len(text), last + 41)
    while at < most:
        if text[at].isspace():
            if not (MORE_RIGHT.match(text, at) or DOT_LAST.search(text, max(0, at - 7), at)):
                break
            while at < most and text[at].isspace():
                at += 1
        else:
            at += 1
    return at


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Places worth a look: groups of triggers with 40 characters on either side, and on to the end of
    the word or dotted run of words there, as far as MAX_TOKENS tokens from the trigger.

    Groups are of bounded length, so the work stays linear; neighbouring stretches may overlap."""
    for first, last in _groups(text, SPELLED):
        yield _left_edge(text, first), _right_edge(text, last)


def _span_features(text: str, a: int, b: int, before: str) -> list[str]:
    span = text[a:b]
    digits = "".join(DIGIT.findall(span))
    n, groups = len(digits), re.findall(r"[0-9]+", span)
    letters = sum(c.isalpha() for c in span)
    edge = (a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_@")) or (b < len(text) and (text[b].isalnum() or text[b] in "_@"))
    out = ["bias", f"digits{min(n, 20)}", f"groups{min(len(groups), 6)}", f"edge{edge}", f"letters{min(letters, 3)}"]
    out.append("separators" + "".join(sorted({c for c in span if not c.isalnum()}))[:6])
    out.append("sizes" + "-".join(str(min(len(g), 5)) for g in groups[:6]) + f"l{letters > 0}")
    if n in range(13, 20) and not letters:
        out.append(f"luhn{luhn(digits)}")
    if len(groups) == 4 and not letters and span.count(".") == 3 and "," not in span:
        out.append(f"quad{all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    if letters:
        plain = re.sub(r"\s*[\[(]?\s*\bdot\b\s*[\])]?\s*", ".", span)
        plain = re.sub(r"\s*[\[(]?\s*\bat\b\s*[\])]?\s*", "@", plain, count=1)
        whole = not MORE_LEFT.search(text, max(0, a - 7), a) and not MORE_RIGHT.match(text, b)
        out.append(f"address{whole and bool(re.fullmatch(r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}', plain))}")
    out.append(f"first{span[0] if not span[0].isalnum() else 'd' if span[0].isdigit() else 'a'}")
    out.append(f"last{span[-1] if not span[-1].isalnum() else 'd' if span[-1].isdigit() else 'a'}")
    if before.lower() in CUES:
        out.append(f"cue{CUES[before.lower()]}")
    return out


def candidates(text: str, a: int, b: int):
    """(tokens, segments): token spans of a stretch, and (i, j, features) of token runs i..j-1
    that hold a digit or an at-sign and neither start nor end within a run of letters or digits."""
    tokens = [m.span() for m in TOKEN.finditer(text, a, b)]
    segments = []
    for i, (start, _) in enumerate(tokens):
        if not (text[start].isalnum() or text[start] in "+("):
            continue
        sure = False
        for j in range(i + 1, min(i + MAX_TOKENS, len(tokens)) + 1):
            end = tokens[j - 1][1]
            piece = text[tokens[j - 1][0] : end]
            if j > i + 1 and ("\n" in text[tokens[j - 2][1] : tokens[j - 1][0]] or piece in ",;:!?#$%&*|=\"'"):
                break
            sure = sure or bool(TRIGGER.search(piece)) or piece == "at"
            if sure and text[end - 1].isalnum() and end - start >= 6:
                before = text[tokens[i - 1][0] : tokens[i - 1][1]] if i else ""
                segments.append((i, j, _span_features(text, start, end, before)))
    return tokens, segments


class SemiMarkovField:
    """Weights of (feature, kind); segments outside entities are single tokens of score 0."""

    def __init__(self, weights: dict[str, list[float]] | None = None):
        self.weights = weights or {}

    def _scores(self, segments) -> np.ndarray:
        none = [0.0] * len(KINDS)
        return np.array([np.sum([self.weights.get(f, none) for f in fs], axis=0) for _, _, fs in segments]).reshape(-1, len(KINDS))

    def marginals(self, n: int, segments) -> np.ndarray:
        """Posterior probability of each (segment, kind), by forward and backward sums."""
        scores = np.clip(self._scores(segments), -60, 60)
        ending: dict[int, list[int]] = {}
        starting: dict[int, list[int]] = {}
        for k, (i, j, _) in enumerate(segments):
            ending.setdefault(j, []).append(k)
            starting.setdefault(i, []).append(k)
        whole = [float(np.logaddexp.reduce(s)) for s in scores]
        ahead, back = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead[j] = float(np.logaddexp.reduce([ahead[j - 1], *(ahead[segments[k][0]] + whole[k] for k in ending.get(j, ()))]))
        for i in range(n - 1, -1, -1):
            back[i] = float(np.logaddexp.reduce([back[i + 1], *(back[segments[k][1]] + whole[k] for k in starting.get(i, ()))]))
        outer = np.array([ahead[i] + back[j] - ahead[n] for i, j, _ in segments])
        return np.exp(np.minimum(scores + outer[:, None], 0))

    def train(self, examples: list, rounds: int = 6, rate: float = 0.5) -> None:
        """examples: (number of tokens, segments, {segment index: kind index}). Adagrad ascent."""
        square: dict[str, np.ndarray] = {}
        weights = {f: np.zeros(len(KINDS)) for _, segments, _ in examples for _, _, fs in segments for f in fs}
        self.weights = weights
        for _ in range(rounds):
            for n, segments, gold in examples:
                if not segments:
                    continue
                slope = -self.marginals(n, segments)
                for k, kind in gold.items():
                    slope[k, kind] += 1
                for k in np.flatnonzero(np.abs(slope).max(axis=1) > 1e-4):
                    for f in segments[k][2]:
                        s = square.setdefault(f, np.full(len(KINDS), 1e-2))
                        s += slope[k] ** 2
                        weights[f] += rate * (slope[k] - 1e-4 * weights[f]) / np.sqrt(s)
        self.weights = {f: w.tolist() for f, w in weights.items()}

    def best(self, n: int, segments) -> list[tuple[int, int, float]]:
        """(segment, kind, posterior) of the best segmentation."""
        if not segments:
            return []
        scores, posterior = self._scores(segments), self.marginals(n, segments)
        top, back = [0.0] * (n + 1), [None] * (n + 1)
        ending: dict[int, list[int]] = {}
        for k, (_, j, _) in enumerate(segments):
            ending.setdefault(j, []).append(k)
        for j in range(1, n + 1):
            top[j] = top[j - 1]
            for k in ending.get(j, ()):
                kind = int(scores[k].argmax())
                value = top[segments[k][0]] + scores[k, kind]
                if value > top[j]:
                    top[j], back[j] = value, (k, kind)
        out, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                k, kind = back[j]
                out.append((k, kind, float(posterior[k, kind])))
                j = segments[k][0]
        return out[::-1]


def _respelled(kind: str, span: str, draw: random.Random) -> str:
    if kind == "phone":
        return re.sub(r"^\+[0-9]{1,3}[ .-]*", "", span) if draw.random() < 0.7 else span.replace(" ", "-")
    if kind == "card":
        digits = "".join(DIGIT.findall(span))
        return draw.choice("- ").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == "email":
        return span.replace("@", " at ").replace(".", " dot ") if draw.random() < 0.5 else span.replace("@", " at ")
    return span


def _spelled_out(span: str) -> list[str]:
    """An address in words: no digit, no at-sign."""
    name, _, host = DIGIT.sub("", re.sub(r"(?<![A-Za-z])[0-9]+(?![A-Za-z])", "x", span)).partition("@")
    forms = (" at ", " dot "), (" at ", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" [at] ", "."), (" (at) ", ".")
    return [name + at + host.replace(".", dot) for at, dot in forms]


def _example(text: str, spans: list):
    tokens, segments = candidates(text, 0, len(text))
    places = {(tokens[i][0], tokens[j - 1][1]): k for k, (i, j, _) in enumerate(segments)}
    gold = {places[a, b]: KINDS.index(kind) for kind, a, b in spans if (a, b) in places}
    return len(tokens), segments, gold


def train_field(docs: DataFrame, max_stretches: int = 400) -> SemiMarkovField:
    """A field from at most max_stretches stretches with and without marked spans.

    A training stretch is a group of triggers with 40 characters on either side. They are those of the documents with the smallest hashes of doc_id, at most four a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in in_chunks(batches, "text"):
            rows = []
            for order, text in zip(chunk.column("order").to_pylist(), chunk.column("text").to_pylist()):
                if text and TRIGGER.search(text):
                    spans = base_spans(text)
                    kinds = set()
                    # spelled-out addresses are not marked: as examples of plain text they would mislead
                    for first, last in _groups(text, TRIGGER):
                        a, b = max(0, first - 40), min(len(text), last + 41)
                        inside = sorted({k for k, x, y in spans if a <= x and y <= b})
                        name = inside[0] if inside else "none"
                        if name not in kinds and b - a <= 300:
                            kinds.add(name)
                            rows.append((name, order, text[a:b]))
            if rows:
                yield pa.record_batch([pa.array(c) for c in zip(*rows)], ["kind", "order", "stretch"])

    texts = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("order"), F.col("text").cast("string"))
    found = texts.mapInArrow(run, "kind string, order long, stretch string")
    each = max_stretches // (len(KINDS) + 1)
    # a max_by over the partial groups keeps the shuffle small and the result bounded
    slots = found.groupBy("kind", F.pmod("order", F.lit(each)).alias("slot")).agg(F.min_by("stretch", F.struct("order", "stretch")).alias("stretch"))
    rows = sorted((r["kind"], r["slot"], r["stretch"]) for r in slots.collect())
    draw, examples = random.Random(7), []
    # where addresses are few, each is shown in more forms
    forms = min(6, max(1, 72 // max(1, sum(kind == "email" for kind, _, _ in rows))))
    for _, _, text in rows:
        spans = [s for s in base_spans(text) if s[0] != "card" or not any(o[0] != "card" and o[1] < s[2] and s[1] < o[2] for o in base_spans(text))]
        examples.append(_example(text, spans))
        if spans:
            kind, a, b = spans[0]
            new = _respelled(kind, text[a:b], draw)
            other = text[:a] + new + text[b:]
            examples.append(_example(other, [(kind, a, a + len(new))]))
            for k in range(forms if kind == "email" else 0):
                spelled = _spelled_out(text[a:b])
                new = spelled[(len(examples) + k) % len(spelled)]
                examples.append(_example(text[:a] + new + text[b:], [(kind, a, a + len(new))]))
    field = SemiMarkovField()
    field.train(examples)
    return field


def all_spans(text: str, field: SemiMarkovField) -> tuple[list, list]:
    """(base spans, all spans), each by kind, then start."""
    base = base_spans(text)
    if not base and not SPELLED.search(text):
        return [], []
    taken = sorted((a, b) for _, a, b in base)
    added, passed = [], 0
    for x, y in stretches(text):
        tokens, segments = candidates(text, x, y)
        # stretches start ever further right, so base spans passed once are passed for good
        while passed < len(taken) and taken[passed][1] <= x:
            passed += 1
        near = [(a, b) for a, b in takewhile(lambda s: s[0] < y, islice(taken, passed, None)) if b > x]
        segments = [s for s in segments if not any(a < tokens[s[1] - 1][1] and tokens[s[0]][0] < b for a, b in near)]
        for k, kind, posterior in field.best(len(tokens), segments):
            if posterior >= LEAST_POSTERIOR:
                i, j, _ = segments[k]
                start, end = tokens[i][0], tokens[j - 1][1]
                # by their ends, so only the last few can overlap
                later = takewhile(lambda s: s[0] > start, reversed(added))
                if all(end <= a for _, a, _ in later):
                    insort(added, (end, start, KINDS[kind]))
    return base, sorted(base + [(kind, a, b) for b, a, kind in added], key=lambda s: (KINDS.index(s[0]), s[1]))


def _listed(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, field: SemiMarkovField) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and base_sha256 are of the base spans, spans lists all. Null text is empty text, with
    counts 0 and the hash of nothing; repeated rows are each answered."""
    weights = docs.sparkSession.sparkContext.broadcast(field.weights)
    make, find = SemiMarkovField, all_spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = make(weights.value)
        for chunk in in_chunks(batches, "text"):
            rows = []
            for text in chunk.column("text").to_pylist():
                base, every = find(text or "", mine)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every)))
            columns = list(zip(*rows))
            yield pa.record_batch(
                [chunk.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4]), pa.array(columns[5])],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def masked(text: str, spans: list) -> str:
    """The text with each stretch of overlapping spans replaced by <KIND> of its first span."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask_personal_data(docs: DataFrame, field: SemiMarkovField, text: str = "text") -> DataFrame:
    """The documents, all other columns as they are, with personal data masked. Null stays null."""
    weights = docs.sparkSession.sparkContext.broadcast(field.weights)
    make, find, place = SemiMarkovField, all_spans, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = make(weights.value)
        for chunk in in_chunks(batches, text):
            new = [t and masked(t, find(t, mine)[1]) for t in chunk.column(text).to_pylist()]
            yield chunk.set_column(place, text, pa.array(new, pa.string()))

    return docs.mapInArrow(run, docs.schema)
