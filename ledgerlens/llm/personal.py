"""Operator 12: personal data by fixed patterns and a semi-Markov CRF.

The patterns (``base_spans``) always count.  A semi-Markov conditional random
field adds spans that they miss: spelled-out mail addresses, other separators,
numbers that a longer run of digits hid.  It scores whole candidate segments
(digit groups, checksum, separators, what stands beside them) and a dynamic
programme over segments of bounded length chooses boundaries and kinds
jointly.  It learns from the patterns' spans in a bounded sample of windows,
and from altered spellings of these spans and of look-alikes.

Only windows around a digit, an at sign or the word "dot" are segmented: each
candidate holds one of them and is at most ``LONGEST`` code points long, so
everywhere else the best segmentation has no entity.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the kinds in their order, and their patterns
KINDS = ("email", "ip", "card", "phone")
_MAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_MAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Bounds of a candidate segment.
LONGEST = 96                         # code points
TOKENS = 40
#: Windows the field is fitted on at most, documents they are taken from (on average).
SAMPLE_WINDOWS = 1_500
SAMPLE_DOCS = 60_000
SAMPLE_CHARS = 800
ALTERED = 2                          # altered copies of each window
EPOCHS = 6
RATE, L2 = 0.4, 1e-3
#: Score of two entities with nothing between them; never above 0 (see ``decode``).
TOUCH = -2.0
#: Log odds by which an entity must beat plain text.
SURE = math.log(9.0)

SPANS = "array<struct<kind: string, start: long, end: long, base: boolean>>"
_DIGIT, _DIGITS, _NO_MARK = re.compile("[0-9]"), re.compile("[0-9]+"), re.compile("[0-9]|dot")
_NINES = str.maketrans("012345678", "999999999")
CACHE_SHAPES = 100_000
_TRIGGER = re.compile(r"[0-9@]|\b(?:dot|DOT|Dot)\b")
_TOKEN = re.compile(
    r"(?P<at>\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s@\s|@|(?<=\w) (?:at|AT) (?=\w))"
    r"|(?P<dot>\s?[\[({<]\s?(?:dot|DOT|Dot|\.)\s?[\])}>]\s?|(?<=\w) (?:dot|DOT|Dot) (?=\w)|\.)"
    r"|(?P<num>[0-9]+)|(?P<word>[A-Za-z]+)|(?P<other>.)", re.S)


# ------------------------------------------------------------ fixed patterns
def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _mails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, each found from its at sign: linear on any text."""
    done, at = 0, text.find("@")
    while at >= 0:
        if host := _MAIL_HOST.match(text, at):
            start = at
            while start > done and _MAIL_LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                yield start, host.end()
                done = host.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns, by start, then kind.

    Matches are leftmost and don't overlap within a kind; one that fails its
    check is dropped without another try inside it.
    """
    found = []
    if "@" in text:
        found += [(s, e, 0) for s, e in _mails(text)]
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), 1) for m in _IP.finditer(text)
                  if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := digits_of(m.group())) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


# ------------------------------------------------------- candidate segments
@dataclass(frozen=True)
class Segment:
    start: int
    end: int
    kind: int
    labels: tuple[str, ...] = ()       # the host's parts, of a mail address
    spelled: bool = False              # its at sign is not a bare @


def windows(text: str) -> list[tuple[int, int]]:
    """Ranges of ``text`` that hold every possible candidate."""
    found: list[tuple[int, int]] = []
    if not (_DIGIT.search(text) or "@" in text or "dot" in text or "DOT" in text or "Dot" in text):
        return found
    for m in _TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - LONGEST), min(len(text), m.end() + LONGEST)
        if found and lo <= found[-1][1]:
            found[-1] = (found[-1][0], hi)
        else:
            found.append((lo, hi))
    return found


def _beside(text: str, at: int) -> str:
    """The kind of character at a place outside a segment."""
    if not 0 <= at < len(text):
        return "end"
    c = text[at]
    return "digit" if "0" <= c <= "9" else "letter" if c.isalpha() else "space" if c.isspace() else c


def _near(text: str, at: int, step: int) -> str:
    """The word next to a segment, if only a few marks stand between."""
    piece = text[max(0, at - 24):at] if step < 0 else text[at:at + 24]
    words = re.findall(r"[^\W\d_]+", piece)
    return (words[-1] if step < 0 else words[0]).lower() if words else ""


def shape_features(text: str, s: Segment) -> list[str]:
    """What the segment's form tells, whatever its digits are."""
    kind, body = KINDS[s.kind], text[s.start:s.end]
    if kind == "email":
        dots = any(c in body for c in "[({<") or " dot " in body.lower()
        return [kind, f"{kind} at={s.spelled}", f"{kind} labels={min(4, len(s.labels))}", f"{kind} dots={dots}",
                f"{kind} last={s.labels[-1].isalpha()}{min(7, len(s.labels[-1]))}", f"{kind} spaces={min(5, body.count(' '))}"]
    sizes = [len(g) for g in _DIGITS.findall(body)]
    marks = "".join(sorted(set(_NO_MARK.sub("", body.lower()))))
    return [kind, f"{kind} digits={sum(sizes)}", f"{kind} groups={len(sizes)}", f"{kind} sizes={'-'.join(map(str, sizes))}",
            f"{kind} marks={marks}", f"{kind} lead={body[0] if not body[0].isdigit() else '9'}"]


def other_features(text: str, s: Segment) -> list[str]:
    """Checks of the digits, and what stands beside the segment."""
    kind, body = KINDS[s.kind], text[s.start:s.end]
    left, right = _beside(text, s.start - 1), _beside(text, s.end)
    found = [f"{kind} left={left}", f"{kind} right={right}", f"{kind} beyond={right}/{_beside(text, s.end + 1)}",
             f"{kind} ahead={_beside(text, s.start - 2)}/{left}", f"{kind} before={_near(text, s.start, -1)}",
             f"{kind} after={_near(text, s.end, 1)}"]
    if kind == "ip":
        found.append(f"ip fits={all(len(g) <= 3 and int(g) <= 255 and str(int(g)) == g for g in _DIGITS.findall(body))}")
    if kind == "card":
        found.append(f"card luhn={luhn(digits_of(body))}")
    if kind != "email":
        found.append(f"{kind} zero={digits_of(body).startswith('00')}")
    return found


def features(text: str, s: Segment) -> list[str]:
    return shape_features(text, s) + other_features(text, s)


def candidates(text: str, lo: int, hi: int) -> Iterator[Segment]:
    """All segments of the window that could be an entity of some kind."""
    tokens = [(m.lastgroup, m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
    for i, (group, start, _) in enumerate(tokens):
        if group == "at":
            yield from _mails_around(text, tokens, i)
        opens = group == "num" or (group == "other" and text[start] in "+(")
        if opens and _beside(text, start - 1) not in ("digit", "letter"):
            yield from _numbers_from(text, tokens, i)


def _mails_around(text: str, tokens: list[tuple], at: int) -> Iterator[Segment]:
    """Every start in the run before an at sign with every end in the labels after it."""
    starts, i = [], at - 1
    while i >= 0 and at - i <= TOKENS // 2 and (tokens[i][0] in ("num", "word") or text[tokens[i][1]:tokens[i][2]] in "._%+-"):
        if tokens[i][0] in ("num", "word") or text[tokens[i][1]] == "_":
            starts.append(tokens[i][1])
        i -= 1
    ends, labels, i, label = [], [], at + 1, ""
    while starts and i < len(tokens) and i - at <= TOKENS // 2:
        group, s, e = tokens[i]
        if group in ("num", "word") or text[s:e] == "-":
            label += text[s:e]
            if labels and label[-1] != "-" and (i + 1 == len(tokens) or tokens[i + 1][0] not in ("num", "word")):
                ends.append((e, [*labels, label]))
        elif group == "dot" and label:
            labels, label = [*labels, label], ""
        else:
            break
        i += 1
    spelled = text[tokens[at][1]:tokens[at][2]] != "@"
    for start in starts:
        whole = _beside(text, start - 1) not in ("digit", "letter")
        for end, parts in ends:
            if whole and end - start <= LONGEST:
                yield Segment(start, end, 0, tuple(parts), spelled)


def _numbers_from(text: str, tokens: list[tuple], first: int) -> Iterator[Segment]:
    """Numbers that begin with a token: addresses, cards and telephone numbers."""
    start, digits, groups, spelled, marks = tokens[first][1], 0, 0, False, set()
    for i in range(first, min(len(tokens), first + TOKENS)):
        group, s, e = tokens[i]
        if e - start > LONGEST:
            return
        if group == "num":
            digits, groups = digits + e - s, groups + 1
            if _beside(text, e) in ("letter", "digit"):
                return
            if groups == 4 and marks == {"dot"} and digits <= 12:
                yield Segment(start, e, 1)
            if not spelled and text[start] not in "+(" and 14 <= digits <= 19 and not marks & {"+", "(", ")"}:
                yield Segment(start, e, 2)
            if not spelled and 7 <= digits <= 15 and text.count("(", start, e) == text.count(")", start, e):
                yield Segment(start, e, 3)
            if digits > 19:
                return
        elif group == "dot":
            spelled = spelled or e - s > 1
            marks.add("dot")
        elif group == "other" and text[s] in " -()/" or (i == first and text[s] == "+"):
            marks.add(text[s])
        else:
            return


# ----------------------------------------------------- semi-Markov CRF
_PLAIN = len(KINDS)                  # label of plain text


class Lattice:
    """Candidates of a window between the places where one starts or ends.

    Plain text scores 0 wherever it stands, so only these places matter.
    """

    def __init__(self, segments: list[Segment]):
        self.segments = segments
        places = sorted({p for s in segments for p in (s.start, s.end)})
        number = {p: k for k, p in enumerate(places)}
        self.size = len(places)
        self.ending: list[list[tuple[int, int]]] = [[] for _ in places]        # place -> (place of the start, segment)
        for k, s in enumerate(segments):
            self.ending[number[s.end]].append((number[s.start], k))

    def best(self, scores: list[float], touch: list[list[float]]) -> list[int]:
        """The segments of the best segmentation (``touch``: score of one kind
        directly after another)."""
        labels = range(_PLAIN + 1)
        score = [[-math.inf] * (_PLAIN + 1) for _ in range(self.size)]
        origin: list[list[tuple[int, int, int] | None]] = [[None] * (_PLAIN + 1) for _ in range(self.size)]
        for at in range(self.size):
            if at == 0:
                score[0][_PLAIN] = 0.0
                continue
            before = max(labels, key=lambda k: score[at - 1][k])
            score[at][_PLAIN], origin[at][_PLAIN] = score[at - 1][before], (at - 1, before, -1)
            for start, k in self.ending[at]:
                kind = self.segments[k].kind
                for label in labels:
                    value = score[start][label] + scores[k] + (touch[label][kind] if label != _PLAIN else 0.0)
                    if value > score[at][kind]:
                        score[at][kind], origin[at][kind] = value, (start, label, k)
        chosen, at = [], self.size - 1
        label = max(labels, key=lambda k: score[at][k]) if self.size else _PLAIN
        while self.size and (step := origin[at][label]) is not None:
            at, label = step[0], step[1]
            if step[2] >= 0:
                chosen.append(step[2])
        return chosen[::-1]

    def marginals(self, scores: list[float], touch: list[list[float]]) -> list[float]:
        """Probability of each segment."""
        labels = range(_PLAIN + 1)
        forward = [[-math.inf] * (_PLAIN + 1) for _ in range(self.size)]
        backward = [[-math.inf] * (_PLAIN + 1) for _ in range(self.size)]
        step = lambda label, kind: touch[label][kind] if label != _PLAIN else 0.0
        forward[0][_PLAIN] = 0.0
        for at in range(1, self.size):
            forward[at][_PLAIN] = _log_sum(forward[at - 1])
            for start, k in self.ending[at]:
                kind = self.segments[k].kind
                reach = _log_sum([forward[start][x] + step(x, kind) for x in labels]) + scores[k]
                forward[at][kind] = _log_sum([forward[at][kind], reach])
        backward[-1] = [0.0] * (_PLAIN + 1)
        for at in range(self.size - 1, 0, -1):
            passed = backward[at][_PLAIN]
            backward[at - 1] = [_log_sum([b, passed]) for b in backward[at - 1]]
            for start, k in self.ending[at]:
                kind = self.segments[k].kind
                rest = backward[at][kind] + scores[k]
                backward[start] = [_log_sum([b, rest + step(x, kind)]) for x, b in enumerate(backward[start])]
        total = _log_sum(forward[-1])
        seen = [0.0] * len(self.segments)
        for at in range(1, self.size):
            for start, k in self.ending[at]:
                kind = self.segments[k].kind
                seen[k] = sum(math.exp(min(0.0, forward[start][x] + step(x, kind) + scores[k] + backward[at][kind] - total))
                              for x in labels)
        return seen


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


class Model:
    """Weights of the features, and the score of one kind directly after another."""

    def __init__(self, weights: dict[str, float], touch: list[list[float]]):
        self.weights, self.touch = weights, touch
        self.shapes: dict[tuple[int, str], float] = {}
        # the most that the features besides the shape can add, by kind
        most: dict[str, float] = {}
        for name, w in weights.items():
            family = name.split("=")[0]
            if family.split(" ")[-1] in ("left", "right", "beyond", "ahead", "before", "after", "fits", "luhn", "zero"):
                most[family] = max(most.get(family, 0.0), w)
        self.most = [sum(w for family, w in most.items() if family.startswith(f"{kind} ")) for kind in KINDS]

    def score(self, text: str, s: Segment, least: float = -math.inf) -> float:
        """The segment's score; one that can't exceed ``least`` is left at -inf."""
        if s.kind == 0:
            shape = sum(self.weights.get(f, 0.0) for f in shape_features(text, s))
        else:                            # numbers of one form share their shape
            form = s.kind, text[s.start:s.end].translate(_NINES)
            if (shape := self.shapes.get(form)) is None:
                if len(self.shapes) >= CACHE_SHAPES:
                    self.shapes.clear()
                shape = self.shapes[form] = sum(self.weights.get(f, 0.0) for f in shape_features(text, s))
        if shape + self.most[s.kind] <= least:
            return -math.inf
        return shape + sum(self.weights.get(f, 0.0) for f in other_features(text, s))


def train(examples: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = EPOCHS, seed: int = 12) -> Model:
    """Fits the field to texts with their true spans by stochastic gradient
    (AdaGrad) on the conditional likelihood of the segmentation."""
    rnd = random.Random(seed)
    lattices, seen = [], Counter()
    for text, spans in examples:
        truth = set(spans)
        for lo, hi in windows(text):
            segments = list(candidates(text, lo, hi))
            if segments:
                traits = [features(text, s) for s in segments]
                lattices.append((Lattice(segments), traits, [float((s.start, s.end, s.kind) in truth) for s in segments]))
                seen.update({f for names in traits for f in names})
    weights: dict[str, float] = {}
    touch = [[TOUCH] * _PLAIN for _ in range(_PLAIN)]
    speed: Counter = Counter()
    common = {f for f, n in seen.items() if n >= 3}
    for _ in range(epochs):
        rnd.shuffle(lattices)
        for lattice, traits, truth in lattices:
            scores = [sum(weights.get(f, 0.0) for f in names) for names in traits]
            expected = lattice.marginals(scores, touch)
            slope: Counter = Counter()
            for names, want, have in zip(traits, truth, expected, strict=True):
                if abs(want - have) > 1e-6:
                    for f in names:
                        if f in common:
                            slope[f] += want - have
            for f, g in slope.items():
                g -= L2 * weights.get(f, 0.0)
                speed[f] += g * g
                weights[f] = weights.get(f, 0.0) + RATE * g / math.sqrt(1e-8 + speed[f])
    return Model(weights, touch)


# ------------------------------------------------------ altered spellings
def _pick(rnd: random.Random, *options: str) -> str:
    return options[rnd.randrange(len(options))]


def _respell(rnd: random.Random, kind: int, span: str) -> str:
    """Another spelling of an entity."""
    if kind == 0:
        local, host = span.split("@", 1)
        if host.count(".") > 1 and rnd.random() < 0.4:
            host = host.split(".", 1)[1]
        if rnd.random() < 0.3:
            local = "".join(c for c in local if c.isalpha()) or local
        at = _pick(rnd, " at ", " [at] ", "[at]", "(at)", " (at) ", " AT ", " @ ")
        dot = _pick(rnd, ".", " dot ", "[dot]", " [dot] ", "(dot)", " DOT ", "[.]")
        return local + at + host.replace(".", dot)
    if kind == 1:
        return span.replace(".", _pick(rnd, "[.]", "(.)", " dot ", "[dot]"))
    digits = digits_of(span)
    if kind == 2:
        mark = _pick(rnd, ".", "/", " ", "-")
        return mark.join(digits[k:k + 4] for k in range(0, len(digits), 4))
    code, rest = (digits[:-10], digits[-10:])
    mark = _pick(rnd, "-", ".", " ", "/")
    body = _pick(rnd, f"({rest[:3]}) {rest[3:6]}-{rest[6:]}", mark.join((rest[:3], rest[3:6], rest[6:])))
    lead = _pick(rnd, "", "", f"{code}{mark}", f"00{code} ", f"({code}) ") if code else ""
    return lead + body


def _look_alike(rnd: random.Random) -> str:
    """Something that looks like an entity and is none."""
    number = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    bare, wrong = (number(n) for n in (rnd.randrange(5, 24), 16))
    while luhn(bare) or luhn(wrong):                       # else it could be a card's number
        bare, wrong = number(len(bare)), number(16)
    return _pick(rnd, bare, wrong, "-".join(wrong[k:k + 4] for k in (0, 4, 8, 12)),
                 f"{rnd.randrange(1900, 2100)}-{rnd.randrange(1, 13):02}-{rnd.randrange(1, 29):02}",
                 f"{rnd.randrange(1, 29)}.{rnd.randrange(1, 13)}.{rnd.randrange(1900, 2100)}",
                 f"{rnd.randrange(1900, 2000)}-{rnd.randrange(2000, 2100)}", f"{rnd.randrange(24):02}:{number(2)}:{number(2)}",
                 f"{rnd.randrange(256, 999)}.{number(2)}.{number(1)}.{number(2)}", f"{number(2)}.{number(1)}.{number(2)}",
                 f"{number(1)}.{number(1)}.{number(1)}.{number(1)}.{number(1)}", f"{number(3)},{number(3)},{number(3)}.{number(2)}",
                 f"{number(3)}-{number(1)}-{number(4)}-{number(4)}-{number(1)}", f"{number(4)} {number(4)}", f"{number(3)} {number(3)} {number(3)}",
                 f"at {number(2)} dot {number(2)}", f"look at this dot {number(1)}", f"@{number(4)}", f"x{number(9)}y{number(6)}")


def altered(text: str, spans: list[tuple[int, int, int]], rnd: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with every span respelled or replaced by a look-alike, and its
    true spans.  Spans that overlap an earlier one are left out."""
    parts, found, at, size = [], [], 0, 0
    for start, end, kind in spans:
        if start < at:
            continue
        body, real = (_respell(rnd, kind, text[start:end]), True) if rnd.random() < 0.55 else (_look_alike(rnd), False)
        lead = f"{rnd.randrange(10)} " if real and kind in (1, 2) and rnd.random() < 0.2 else ""
        parts += [text[at:start], lead, body]
        size += start - at + len(lead)
        if real:
            found.append((size, size + len(body), kind))
        size += len(body)
        at = end
    return "".join([*parts, text[at:]]), found


# ------------------------------------------------------------- on Spark
def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the texts that hold a span of the patterns, cut out with some text around."""
    for batch in batches:
        found = set()
        for text in batch.column("text"):
            text = text.as_py() or ""
            spans = base_spans(text)
            for lo, hi in windows(text) if spans else ():
                if hi - lo <= SAMPLE_CHARS and any(lo <= s[0] < hi for s in spans):
                    found.add(text[max(0, lo - 8):hi + 8])
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["piece"])


def fit(docs: DataFrame) -> Model:
    """Learns from about SAMPLE_DOCS rows of ``docs`` (text), at most
    SAMPLE_WINDOWS different windows of them (of up to SAMPLE_CHARS code
    points), each as it is and ALTERED times altered.  Without any span the model adds
    nothing."""
    total = docs.count()
    rows = docs.select("text") if total <= SAMPLE_DOCS else docs.select("text").where(
        F.pmod(F.xxhash64("text", F.lit(12)), F.lit(1_000_003)) < F.lit(1_000_003 * SAMPLE_DOCS // total))
    pieces = rows.mapInArrow(_samples, "piece string").distinct().orderBy(F.xxhash64("piece", F.lit(7)), "piece") \
        .limit(SAMPLE_WINDOWS).collect()
    rnd = random.Random(5)
    examples = [(r["piece"], base_spans(r["piece"])) for r in pieces]
    return train([*examples, *(altered(t, s, rnd) for _ in range(ALTERED) for t, s in examples)])


def _covered(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the ranges that ``spans`` (by start) cover."""
    starts, ends = [], []
    for start, end, _ in spans:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def decode(text: str, model: Model, fixed: list[tuple[int, int, int]] = ()) -> list[tuple[int, int, int]]:
    """The best segmentation's entities (start, end, kind number) beside the ``fixed`` spans.

    A candidate that is worth nothing by itself never raises the total, since
    touching another entity only costs; the others are segmented group by
    group of overlapping or touching ones.
    """
    starts, ends = _covered(fixed)
    found, group, scores, reach = [], [], [], -1

    def close() -> None:
        found.extend((group[k].start, group[k].end, group[k].kind) for k in Lattice(group).best(scores, model.touch))
        group.clear()
        scores.clear()

    for lo, hi in windows(text):
        worth = []
        for s in candidates(text, lo, hi):
            at = bisect_right(ends, s.start)                     # the first range that ends behind the start
            if (at == len(starts) or s.end <= starts[at]) and (score := model.score(text, s, SURE) - SURE) > 0:
                worth.append((s, score))
        for s, score in sorted(worth, key=lambda w: (w[0].start, w[0].end, w[0].kind)):
            if group and s.start > reach:
                close()
            group.append(s)
            scores.append(score)
            reach = max(reach, s.end)
    if group:
        close()
    return found


def spans_of(text: str, model: Model) -> list[tuple[int, int, int, bool]]:
    """(start, end, kind number, from the patterns) of all spans, by start, then kind.

    The patterns' spans are fixed; the segmentation decides the rest.
    """
    base = base_spans(text)
    added = decode(text, model, base) if model.weights else []
    return sorted([(*s, True) for s in base] + [(*s, False) for s in added], key=lambda s: (s[0], s[2]))


def _find(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, e, k, b in spans_of(t.as_py() or "", model)]
                    for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])
    return run


def personal_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and spans, an array of
    (kind, start, end, base) by start, then kind; code points, end exclusive.

    ``base`` tells the fixed patterns' spans, which are all there, from those
    the field added; added spans overlap neither these nor each other.  A null
    or empty text has none.  Rows are kept one to one, other columns ignored;
    without a model one is fitted on ``docs``.
    """
    model = fit(docs) if model is None else model
    return docs.select("doc_id", "text").mapInArrow(_find(model), f"doc_id long, spans {SPANS}")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
