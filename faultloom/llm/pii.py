"""Personal data: fixed patterns, and a linear-chain conditional random field for what is written around them.

The patterns (base spans) find plain e-mail and IP addresses, card and phone numbers. The field reads the neighbourhood
of every digit, @, bracketed at/dot and word "dot" of a text as tokens (runs of letters, runs of digits, single marks) with
features of their shapes and those of their neighbours, labels them B-kind, I-kind or O, and is decoded by Viterbi for
many neighbourhoods at once; tokens elsewhere are O by rule. It is trained by gradient on a small table of marked
lines. A decoded span is added if it overlaps no base span and stands a check of its digits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, tidy

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

#: Characters on either side of a trigger that the field reads; features are hashed to DIMS.
REACH, DIMS = 48, 1 << 12
COPIES, STEPS, RATE, DECAY, SEED = 12, 120, 0.15, 1e-4, 3

#: Characters of a stretch that are decoded at once, those read beyond either end (spans are shorter), and tokens held.
LONG, MARGIN, HELD = 16_384, 512, 50_000

_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[({<](?:at|dot)[\])}>]|\bdot\b", re.IGNORECASE)
_SEEN = re.compile(rb"[0-9@]|[\[({<](?:at|dot)[\])}>]|\bdot\b", re.IGNORECASE)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]", re.UNICODE)

#: The labelled table: lines with marked spans. Digits are drawn anew for every training copy.
MARKED = """
write to <email>anna.berg (at) example (dot) com</email> for details
contact <email>j_smith[at]mail[dot]example[dot]org</email> before noon
mail <email>sales (at) shop.example.net</email> or come by
reach me under <email>peter {at} site {dot} de</email> please
my address is <email>info at example (dot) com</email>, thanks
send it to <email>bob(at)example.com</email>.
write to <email>jane at example dot org</email> today
mail <email>m.keller at post dot example dot de</email> or call
he put a dot at the end of line 4
the dot on the map at noon
a dot matrix printer at work and a dot product
Kontakt: <email>maria.lopez [at] correo [dot] es</email>
<email>a.b (AT) c.example (DOT) fr</email> is the address
the meeting is at 10 (see room 4) and ends at 12
see section 4 (dot points) and table 12
he was at home (at least until 9) on day 3
the dot com boom of 1999 and 2000
the host <ip>10[.]20[.]30[.]40</ip> was blocked
traffic from <ip>192[.]168[.]17[.]25</ip> and others
connect to <ip>97 . 51 . 17 . 173</ip> now
server <ip>172(.)16(.)4(.)99</ip> answers
block <ip>83[dot]229[dot]25[dot]121</ip> at once
address <ip>129 (dot) 38 (dot) 82 (dot) 176</ip> is down
from <ip>161[.]17.88[.]162</ip> to the gate
version 1.2.3 of the tool and 4.5.6 of the library
chapter 3 . 4 and verse 12 . 7 follow
pages 10, 20, 30, 40 and 50
the numbers 12 34 56 78 were drawn
pay with <card>4845.1681.1440.7329</card> today
card <card>4417/7442/8035/1547</card> expires soon
charge <card>4929_3483_8514_6305</card> please
number <card>4952.9359 0025.3043</card> was used
my card is <card>4736 / 9625 / 7309 / 9581</card> thanks
use <card>5105  1051  0510  5100</card> for it
order 500648960 shipped with invoice 0048271
serial 239040950064896 and batch 20240117
isbn 978-3-16-148410-0 in print
id = "908038b7daaf91e730d2f64001c52934d43d"
token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8"
call <phone>(487) 555-7209</phone> in the morning
phone <phone>487-555-7209</phone> or write
tel. <phone>017 555 7713</phone> is mine
ring <phone>(974) 555 3436</phone> after six
fax <phone>243.555.5526</phone> works too
my number: <phone>1 (132) 555-1352</phone>, call me
Telefon <phone>(0)30 555-9246</phone> im Amt
mobile <phone>0171 / 555 2028</phone> any time
tel <phone>01 42 68 53 00</phone> le matin
text <phone>[377] 555-0271</phone> tonight
on 2024-01-17 at 10:30 we met
from 12-05-1999 until 31.12.2003
the score was 3-2, then 14-12 and 555-0 in total
prices rose by 12.5 % to 1,250.00 in 2019
about 1 000 000 people and 25 000 cars
figure 12 (a) and 13 (b), lines 100-250
room 487, floor 3, building 12
it took 48 (of 72) hours and 15 minutes
the ratio 16 / 9 and 4 / 3 are common
scores of 101, 202, 303 and 404 points
act 5, scene 2, line 1729
a plain sentence without any number at all
the of and to in is that for it on was with
die der und in den von zu das mit sich
le de un et que il en pour dans ce
el la de que en un por con no una
word | word | 17 | word | 42 | word
AND THE OF!! WITH!! 44!! ON!!
onor*** erheat$$$ 12&&& the### of%%%
"""


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        x = int(d) * (1 + n % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches, sorted; leftmost, not overlapping within a kind, in linear time."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _EMAIL_HEAD.match(text[start - 1]):
            start -= 1
        found = _EMAIL_TAIL.match(text, at) if start < at else None
        if found:
            last = found.end()
            out.append((start, last, 0))
        at = text.find("@", max(at + 1, last))
    out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def stands(text: str, kind: int) -> bool:
    """The digit check of a decoded span."""
    numbers = re.findall(r"[0-9]+", text)
    digits = "".join(numbers)
    if kind == 0:
        return bool(re.search(r"@|\bat\b", text, re.IGNORECASE)) and bool(re.search(r"\.|\bdot\b", text, re.IGNORECASE)) and len(text) <= 120
    if kind == 1:
        return len(numbers) == 4 and all(map(_small, numbers)) and bool(re.search(r"[\[({]", text) or " . " in text)
    if kind == 2:
        return 12 <= len(digits) <= 19 and all(len(n) >= 2 for n in numbers) and len(numbers) >= 3 and luhn(digits)
    twos = len(numbers) == 5 and all(len(n) == 2 for n in numbers) and numbers[0][0] == "0"
    return 9 <= len(digits) <= 15 and 2 <= len(numbers) <= 5 and len(text) <= 24 and (len(numbers[-1]) >= 3 or twos)


def neighbourhoods(text: str) -> list[tuple[int, int]]:
    """Disjoint stretches that cover REACH characters around each trigger, widened to blanks."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        start, end = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    for stretch in out:
        for _ in range(REACH):
            if stretch[0] > 0 and not text[stretch[0] - 1].isspace():
                stretch[0] -= 1
            if stretch[1] < len(text) and not text[stretch[1]].isspace():
                stretch[1] += 1
    merged: list[tuple[int, int]] = []
    for a, b in out:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def windows(start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, last) of what is read and (from, to) of where spans may begin, for pieces of LONG characters of a stretch."""
    for at in range(start, end, LONG):
        yield max(start, at - MARGIN), min(end, at + LONG + MARGIN), at, min(end, at + LONG)


_CUES = frozenset("at dot com org net de fr es phone tel telefon call fax mobile card ip host server mail email e contact kontakt number".split())


def shape(token: str) -> str:
    """Shape of a token: its mark, its case, or its number of digits and size."""
    if token[0].isdigit() and token.isascii():
        return f"d{min(len(token), 17)}{'s' if len(token) < 4 and _small(token) else ''}"
    if token.isalpha():
        return "X" if token.isupper() else "Xx" if token[0].isupper() else "x"
    return token if token.isascii() else "?"


def features(tokens: list[tuple[int, int, str]]) -> list[list[int]]:
    """Hashed features of each token (start, end, text) of a stretch."""
    shapes = ["<", "<", *(shape(t) for _, _, t in tokens), ">", ">"]
    words = [t.lower() if t.lower() in _CUES else "" for _, _, t in tokens]
    words = ["", "", *words, "", ""]
    out = []
    for n, (start, _, _) in enumerate(tokens):
        k = n + 2
        glued = "g" if n and tokens[n - 1][1] == start else "b"
        near = "g" if n + 1 < len(tokens) and tokens[n + 1][0] == tokens[n][1] else "b"
        told = (
            "1", f"s{shapes[k]}", f"w{words[k]}", f"s{shapes[k]}{glued}{near}", f"p{shapes[k - 1]}{glued}", f"n{shapes[k + 1]}{near}", f"ps{shapes[k - 1]}|{shapes[k]}{glued}", f"sn{shapes[k]}|{shapes[k + 1]}{near}",
            f"pp{shapes[k - 2]}|{shapes[k - 1]}|{shapes[k]}", f"nn{shapes[k]}|{shapes[k + 1]}|{shapes[k + 2]}", f"c{shapes[k - 1]}|{shapes[k]}|{shapes[k + 1]}", f"vp{words[k - 1]}|{words[k - 2]}", f"vn{words[k + 1]}|{words[k + 2]}",
        )
        out.append([_slot(x) for x in told])
    return out


def _slot(name: str) -> int:
    h = 2166136261
    for b in name.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % DIMS


FEATURES = 13


def tokens_of(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]


class Field:
    """Weights by feature and label, and by pair of labels; I-kind follows B-kind or I-kind of its kind only."""

    def __init__(self) -> None:
        n = len(LABELS)
        self.emit, self.move = np.zeros((DIMS, n)), np.zeros((n, n))
        self.allowed = np.zeros((n, n))
        for j in range(2, n, 2):
            self.allowed[[i for i in range(n) if i not in (j, j - 1)], j] = -1e4
        self.begin = np.array([0.0, *([0.0, -1e4] * len(KINDS))])

    def emissions(self, slots: np.ndarray) -> np.ndarray:
        """Scores (stretches x tokens x labels) of padded feature slots (stretches x tokens x FEATURES)."""
        return self.emit[slots].sum(2)

    def fit(self, stretches: list[list[list[int]]], labels: list[list[int]]) -> Field:
        """AdaGrad on the mean negative log likelihood, by forward and backward sums over all stretches at once."""
        slots, mask = pad(stretches)
        gold = np.zeros(mask.shape, np.int64)
        for k, x in enumerate(labels):
            gold[k, : len(x)] = x
        n, rows, lengths = len(LABELS), np.arange(len(stretches)), mask.sum(1)
        flat, gold_pairs = slots[mask].ravel(), np.zeros((n, n))
        np.add.at(gold_pairs, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
        total_emit, total_move = np.full(self.emit.shape, 1e-8), np.full(self.move.shape, 1e-8)
        for _ in range(STEPS):
            score, move = self.emissions(slots), self.move + self.allowed
            alpha = np.zeros_like(score)
            alpha[:, 0] = score[:, 0] + self.begin
            for t in range(1, score.shape[1]):
                new = _logsum(alpha[:, t - 1, :, None] + move, 1) + score[:, t]
                alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
            norm = _logsum(alpha[:, -1], 1)
            beta = np.zeros_like(score)
            pairs = np.zeros((n, n))
            for t in range(score.shape[1] - 2, -1, -1):
                on = mask[:, t + 1]
                ahead = move + (score[:, t + 1] + beta[:, t + 1])[:, None, :]
                pairs += np.exp(alpha[on, t][:, :, None] + ahead[on] - norm[on, None, None]).sum(0)
                beta[:, t] = np.where(on[:, None], _logsum(ahead, 2), 0)
            share = np.exp(alpha + beta - norm[:, None, None]) * mask[..., None]
            share[rows[:, None], np.arange(mask.shape[1]), gold] -= mask
            pairs -= gold_pairs
            grad = np.stack([np.bincount(flat, np.repeat(x, FEATURES), DIMS) for x in share[mask].T], 1)
            grad, pairs = grad / lengths.sum() * 10 + DECAY * self.emit, pairs / lengths.sum() * 10 + DECAY * self.move
            total_emit += grad * grad
            total_move += pairs * pairs
            self.emit -= RATE * grad / np.sqrt(total_emit)
            self.move -= RATE * pairs / np.sqrt(total_move)
        return self

    def decode(self, stretches: list[list[list[int]]]) -> list[np.ndarray]:
        """Best labels of each stretch by Viterbi; stretches of similar length are decoded together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(stretches)
        order, at, move = sorted(range(len(stretches)), key=lambda k: len(stretches[k])), 0, self.move + self.allowed
        while at < len(order):
            end = at
            while end < len(order) and (end - at + 1) * len(stretches[order[end]]) <= max(20_000, len(stretches[order[end]])):
                end += 1
            some = order[at:end]
            slots, mask = pad([stretches[k] for k in some])
            score = self.emissions(slots)
            best, back = score[:, 0] + self.begin, np.zeros(score.shape, np.int64)
            for t in range(1, score.shape[1]):
                every = best[:, :, None] + move
                back[:, t] = np.where(mask[:, t, None], every.argmax(1), np.arange(len(LABELS)))
                best = np.where(mask[:, t, None], every.max(1) + score[:, t], best)
            now, labels = best.argmax(1), np.zeros(mask.shape, np.int64)
            for t in range(score.shape[1] - 1, -1, -1):
                labels[:, t] = now
                now = np.take_along_axis(back[:, t], now[:, None], 1)[:, 0]
            for k, row, on in zip(some, labels, mask, strict=True):
                out[k] = row[on]
            at = end
        return out


def decoded(tokens: list[tuple[int, int, str]], labels: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of the labelled runs of a stretch."""
    at = 0
    while at < len(labels):
        end = at + 1
        if labels[at]:
            kind = int(labels[at] - 1) // 2
            while end < len(labels) and labels[end] == 2 * kind + 2:
                end += 1
            yield tokens[at][0], tokens[end - 1][1], kind
        at = end


def pad(stretches: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, stretches), default=0)
    slots, mask = np.zeros((len(stretches), longest, FEATURES), np.int64), np.zeros((len(stretches), longest), bool)
    for k, x in enumerate(stretches):
        if x:
            slots[k, : len(x)], mask[k, : len(x)] = x, True
    return slots, mask


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def labelled_table(spark: SparkSession) -> DataFrame:
    """The default labelled table: one column, marked."""
    return spark.createDataFrame([(x,) for x in MARKED.strip().split("\n")], "marked string")


def train(labelled: DataFrame) -> Field:
    """Fit on marked lines (a small table; null lines are skipped), COPIES times with other digits.

    Fields are kept by their lines: a session trains on the same table once.
    """
    return _trained(tuple(sorted(r[0] for r in labelled.select("marked").where("marked is not null").collect())))


@cache
def _trained(lines: tuple[str, ...]) -> Field:
    rng = np.random.default_rng(SEED)
    stretches, labels = [], []
    for _ in range(COPIES):
        for line in lines:
            text, spans = unmark(redrawn(line, rng))
            tokens = tokens_of(text)
            own = [0] * len(tokens)
            for a, b, kind in spans:
                inside = [n for n, (s, e, _) in enumerate(tokens) if a <= s and e <= b]
                for n in inside:
                    own[n] = 2 * kind + (1 if n == inside[0] else 2)
            if tokens:
                stretches.append(features(tokens))
                labels.append(own)
    return Field().fit(stretches, labels) if stretches else Field()


def unmark(line: str) -> tuple[str, list[tuple[int, int, int]]]:
    """Text and (start, end, kind) of a marked line."""
    text, spans, at = "", [], 0
    for m in re.finditer(rf"<({'|'.join(KINDS)})>(.*?)</\1>", line):
        text += line[at : m.start()]
        spans.append((len(text), len(text) + len(m[2]), KINDS.index(m[1])))
        text, at = text + m[2], m.end()
    return text + line[at:], spans


def redrawn(line: str, rng: np.random.Generator) -> str:
    """A marked line with other digits: numbers of an address are 255 at most, others keep their number of digits."""
    address = lambda m: str(rng.integers(0, 256))
    other = lambda m: "".join(map(str, rng.integers(0, 10, len(m[0]))))
    return "".join(re.sub(r"[0-9]+", address if part.startswith("<ip>") else other, part) for part in re.split(r"(<ip>.*?</ip>)", line))


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_email, n_ip, n_card, n_phone (base spans), n_added, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, sorted by start and then by kind, comma-joined; base_sha256
    is of the base spans' string, spans has the added ones too. Null and empty texts have none. Rows repeated with one
    id, and rows without one, are each searched. Other columns are ignored, whatever their names; an empty docs gives no
    rows. Patterns run over whole texts; the field decodes a stretch of more than LONG characters in pieces that overlap.
    """
    arrow_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    told = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base: list[list] = [[] for _ in range(len(batch))]
            added: list[list] = [[] for _ in range(len(batch))]
            asked: list[tuple] = []

            def decode() -> None:
                for (n, text, start, stop, tokens), labels in zip(asked, field.decode([features(x[4]) for x in asked]), strict=True):
                    for a, b, kind in decoded(tokens, labels):
                        if start <= a < stop and stands(text[a:b], kind) and not any(s < b and a < e for s, e, _ in base[n]):
                            added[n].append((a, b, kind))
                asked.clear()

            held = 0
            for n, raw in enumerate(batch.column("text")):
                if not raw.is_valid or not _SEEN.search(raw.as_buffer()):
                    continue
                text = raw.as_py().decode("utf-8", "replace")
                base[n] = base_spans(text)
                for first, last, start, stop in (w for a, b in neighbourhoods(text) for w in windows(a, b)):
                    asked.append((n, text, start, stop, tokens_of(text, first, last)))
                    held += len(asked[-1][4])
                    if held >= HELD:
                        decode()
                        held = 0
            decode()
            counts = [[sum(s[2] == k for s in spans) for spans in base] for k in range(len(KINDS))]
            every = [sorted(x + y, key=lambda s: (s[0], s[2], s[1])) for x, y in zip(base, added, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array([len(x) for x in added], pa.int64()), pa.array([hashlib.sha256(told(x).encode()).hexdigest() for x in base]), pa.array([told(x) for x in every])],
                names=["id", *(f"n_{k}" for k in KINDS), "n_added", "base_sha256", "spans"],
            )

    out = source.mapInArrow(tidy(search), f"id {id_type}, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)
