"""Personal data: exact base patterns, and further spans that boosted trees choose among candidates.

High-recall generators propose overlapping spans (digit groups, masked addresses, account numbers, hardware and IPv6
addresses), and base spans are candidates, too. Gradient-boosted trees score each from its format and from the words around
it. They are trained here, on seeded samples of public formats and of look-alikes (dates, prices, versions, measures, serial
numbers); their scores are calibrated on a part of the sample that the trees didn't see, and each kind has the threshold that
keeps the wanted precision there. Base spans stay by contract; of the others that reach their threshold the kind of the
stricter format wins, then the better score, and none overlaps a span that stays.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.boosting import Trees, calibrate, threshold

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match can only start where a run of digits does, as the first part takes the whole run
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
MORE = ("iban", "mac", "ipv6", "ssn")
PRECISION = 0.97
SAMPLE = 7_000

#: Spans that reach further back than this are looked for one by one.
LONGEST = 1 << 30

Span = tuple[str, int, int]


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each @ with all that can stand before it since the last match, and its domain. Linear."""
    done = last = 0
    at = text.find("@")
    while at >= 0:
        low = max(done, last)
        start = low + len(text[low:at].rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        last = at + 1
        at = text.find("@", max(last, done))


def base_spans(text: str) -> list[Span]:
    """The base patterns, by kind and then start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


DIGIT_GROUPS = re.compile(r"(?<![0-9A-Za-z+.-])(?:\(\+?[0-9]{1,4}\)|[0-9]++)(?:(?:[ ./-]{1,2}| / | - )(?:\([0-9]++\)|[0-9]++)){1,7}(?![0-9A-Za-z])|(?<![0-9A-Za-z+.-])\([0-9]++\)[0-9]++(?:[ ./-][0-9]++)*(?![0-9A-Za-z])")
PLAIN = re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{7,}(?![0-9A-Za-z])")
AT, DOT = r"(?:\(at\)|\[at\]|\{at\}|<at>| at )", r"(?: ?(?:\(dot\)|\[dot\]|\{dot\}|<dot>| dot ) ?|\.)"
MASK = re.compile(AT, re.I)
MASKED = re.compile(rf" ?{AT} ?([A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)+)", re.I)
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
MAC = re.compile(r"(?<![0-9A-Za-z:.-])(?:[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}|[0-9A-Fa-f]{4}(?:\.[0-9A-Fa-f]{4}){2})(?![0-9A-Za-z:.-])")
IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:|::)[0-9A-Fa-f:]*[0-9A-Fa-f](?![0-9A-Za-z:])")


def masked(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with their signs written out: each sign with the word before it and the domain after it. Linear."""
    done = 0
    for m in MASKED.finditer(text):
        start = done + len(text[done : m.start()].rstrip(LOCAL))
        if start < m.start():
            yield start, m.end()
        done = m.end()


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data, overlapping ones too, apart from base spans."""
    out: list[Span] = []
    for m in DIGIT_GROUPS.finditer(text):
        kind = "ssn" if re.fullmatch(r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}", m[0]) else "phone"
        if len(digits(m[0])) >= 6:
            out.append((kind, *m.span()))
    out += [("phone", *m.span()) for m in PLAIN.finditer(text)]
    if MASK.search(text):
        out += [("email", *span) for span in masked(text)]
    out += [("iban", *m.span()) for m in IBAN.finditer(text)]
    if ":" in text or "-" in text or "." in text:
        out += [("mac", *m.span()) for m in MAC.finditer(text)]
    if ":" in text:
        out += [("ipv6", *m.span()) for m in IPV6.finditer(text) if m[0].count(":") >= 2 and m[0].count("::") < 2 and ":::" not in m[0] and (m[0].count(":") == 7 or "::" in m[0] and m[0].count(":") < 8)]
    return out


GOOD_WORDS = ("phone", "tel", "call", "mobile", "fax", "contact", "cell", "reach", "whatsapp", "ssn", "social security", "iban", "account", "mail", "mac", "address", "ip", "host")
BAD_WORDS = ("version", "page", "date", "isbn", "order", "invoice", "price", "serial", "part", "room", "line", "score", "figure", "table", "chapter", "build", "ticket", "cost", "total", "section", "model", "item")


def mod97(s: str) -> bool:
    s = s.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


DOMAINS = frozenset("com org net edu gov io ai co info biz eu de fr es it nl at ch uk us ca au jp".split())


def is_date(parts: list[str]) -> bool:
    """Whether three numbers can be a date in some order."""
    if len(parts) != 3 or not all(len(x) in (1, 2, 4) for x in parts):
        return False
    a, b, c = map(int, parts)
    year = (1000 <= a <= 2999 and len(parts[0]) == 4, 1000 <= c <= 2999 and len(parts[2]) == 4 or len(parts[2]) == 2)
    return year[0] and 1 <= b <= 31 and 1 <= c <= 31 or year[1] and 1 <= a <= 31 and 1 <= b <= 31


def features(text: str, span: Span, base: bool = False) -> list[float]:
    """What the trees see of a candidate: its format, and the words around it."""
    kind, a, b = span
    s = text[a:b]
    d = digits(s)
    before = text[max(0, a - 40) : a].lower()
    after = text[b : b + 16].lower()
    parts = re.findall(r"[0-9]+", s)
    groups = [len(x) for x in parts]
    first = int(d[:4]) if len(d) >= 4 else 0
    return [
        float((*KINDS, *MORE).index(kind)), float(len(d)), float(b - a), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)), float(groups[-1] if groups else 0), float(groups[0] if groups else 0),
        float(s.count("-")), float(s.count(" ")), float(s.count(".")), float(s.count("/")), float("(" in s), float(any(w in before for w in GOOD_WORDS)), float(any(w in before for w in BAD_WORDS)), float(d[:1] == "0"), float(d[:2] == "00"),
        float(is_date(parts)), float(1900 <= first <= 2100), float(kind == "iban" and mod97(s)), float(before[-1:] in ("$", "€", "£", "#") or before[-2:-1] in ("$", "€", "£", "#")), float(after.startswith(("%", " %", " km", " kg", "€", " €", " ms", " mb", "mb"))), float(len(set(d))),
        float(s.count(":")), float("::" in s), float(sum(c.isalpha() for c in s)), float(bool(before) and before[-1:].isalnum()), float(bool(re.search(r"[(\[{<]", s)) and kind == "email"), float(" dot " in s.lower()), float(kind == "email" and s.rsplit(".", 1)[-1].rsplit(" ", 1)[-1].lower() in DOMAINS), float(all(len(x) == groups[0] for x in parts)), float(base),
    ]


def iban(r: random.Random, good: bool = True) -> str:
    country, n = r.choice((("DE", 18), ("FR", 23), ("GB", 18), ("ES", 20), ("NL", 14), ("AT", 16), ("CH", 17), ("BE", 12), ("PL", 24)))
    letters = "0123456789" if country in ("DE", "ES", "AT", "BE", "PL") else "0123456789ABCDEFGHJKLMNPRSTUVWXYZ"
    body = "".join(r.choice(letters) for _ in range(n))
    number = "".join(str(int(c, 36)) for c in body + country)
    check = 98 - int(number + "00") % 97
    s = f"{country}{(check if good else (check + r.randint(1, 90)) % 97):02d}{body}"
    return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s


def phone(r: random.Random) -> str:
    """Digits in groups, as numbers are written in many places: with a trunk zero, a prefix in brackets or in bare groups."""
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    sep = r.choice((" ", "-", ".", "/", " ", " / ", " - "))
    if r.random() < 0.2:  # pairs
        return sep.join(["0" + num(1), *(num(2) for _ in range(4))])
    first = r.choice((lambda: "0" + num(r.randint(1, 4)), lambda: f"(0{num(r.randint(1, 4))})", lambda: f"({r.randint(2, 9)}{num(2)})", lambda: f"{r.randint(2, 9)}{num(2)}", lambda: f"00{r.randint(1, 9)}{num(1)}", lambda: f"1-{r.randint(2, 9)}{num(2)}"))()
    rest, left = [], r.randint(9, 12) - len(digits(first))
    while left > 0:
        k = min(left, r.choice((2, 3, 4, 4, 7, 8)))
        if left - k == 1:
            k = left
        rest.append(num(k))
        left -= k
    return first + (r.choice((" ", sep, "")) if first.endswith(")") else sep) + sep.join(rest)


def ipv6(r: random.Random) -> str:
    groups = ["%x" % r.randint(0, 0xFFFF) for _ in range(8)]
    if r.random() < 0.6:
        i = r.randint(1, 5)
        j = r.randint(i + 1, 7)
        return ":".join(groups[:i]) + "::" + ":".join(groups[j:])
    return ":".join(groups)


def sample(n: int = SAMPLE, seed: int = 11) -> list[tuple[str, Span, int, bool]]:
    """Labelled candidates: (text, span, whether it is personal, whether it is a base span)."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    wrap = lambda x: r.choice(("({})", "[{}]", "{{{}}}", "<{}>", " {} ")).format(r.choice((x, x.upper())))
    name = lambda: word() + r.choice(("", ".", "_", "-")) + word()
    year = lambda: r.randint(1900, 2035)
    positive = [
        *[lambda: phone(r)] * 6, lambda: f"{r.randint(1, 899):03d}-{num(2)}-{num(4)}", *[lambda: iban(r)] * 2, lambda: f"{name()}{r.choice(('', ' '))}{wrap('at').strip() if r.random() < 0.5 else wrap('at')}{r.choice(('', ' '))}{word()}{r.choice(('.', wrap('dot')))}{r.choice(tuple(sorted(DOMAINS)))}",
        lambda: r.choice(":-").join(hexa(2) for _ in range(6)), lambda: ".".join(hexa(4) for _ in range(3)), *[lambda: ipv6(r)] * 2,
        lambda: f"{name()}@{word()}.{r.choice(('com', 'org', 'de'))}", lambda: ".".join(str(r.randint(1, 254)) for _ in range(4)), lambda: f"+{r.randint(1, 99)} {num(3)} {num(3)} {num(4)}",
    ]
    negative = [
        lambda: f"{year()}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/{year()}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{year()}", lambda: num(r.randint(7, 14)), lambda: f"{year()}-{year()}", lambda: f"{num(3)}-{num(5)}", lambda: f"{num(4)}/{num(4)}",
        lambda: f"{num(2)} {num(3)} {num(3)}", lambda: f"{r.randint(1, 9)} {num(3)} {num(3)}", lambda: f"{num(2)}.{num(2)}.{num(3)}", lambda: " ".join(num(4) for _ in range(4)), lambda: f"{num(5)} {num(5)}", lambda: " ".join(num(r.randint(1, 2)) for _ in range(r.randint(5, 7))), lambda: f"97{r.choice('89')}-{num(1)}-{num(3)}-{num(5)}-{num(1)}",
        *[lambda: iban(r, False)] * 4, lambda: f"{r.randint(0, 179)}.{num(4)}{r.choice((' ', ', '))}{r.randint(0, 89)}.{num(4)}", lambda: f"{r.randint(1, 99)}.{num(r.randint(2, 5))} {r.randint(1, 99)}.{num(r.randint(2, 5))}", lambda: f"{word()} at {word()}.{word()}", lambda: f"{r.choice('ABDEKX')}{r.choice('ABDEKX')}{num(2)}{num(8)}{num(4)}", lambda: ":".join(str(r.randint(10, 59)) for _ in range(r.randint(3, 8))), lambda: f"{word()} at {word()}.", lambda: f"{word()} at {word()}. {word()}", lambda: f"{year()}{r.randint(1, 12):02d}{r.randint(1, 28):02d}{num(6)}", lambda: f"{num(3)}.{num(3)}.{num(3)}", lambda: f"{word()}::{word()}", lambda: f"{r.randint(10, 23)}:{num(2)}:{num(2)}.{num(3)}",
    ]
    out: list[tuple[str, Span, int, bool]] = []
    while len(out) < n:
        y = int(r.random() < 0.5)
        s = r.choice(positive if y else negative)()
        lead = " ".join(word() for _ in range(r.randint(2, 5)))
        if y and r.random() < 0.35:
            lead += " " + r.choice(GOOD_WORDS)
        if not y and r.random() < 0.35:
            lead += " " + r.choice(BAD_WORDS)
        text = f"{lead}{r.choice((' ', ': ', ' '))}{s}{r.choice((' ', '. ', ', '))}{word()} {word()}"
        spot = text.index(s)
        base = base_spans(text)
        near = lambda c: c[1] < spot + len(s) and c[2] > spot
        out += [(text, c, y, True) for c in base if near(c)]
        out += [(text, c, y, False) for c in candidates(text) if near(c)]
    return out[:n]


@lru_cache(1)
def model() -> tuple[Trees, float, float, dict[str, float]]:
    """Trees, calibration and a threshold for each kind."""
    rows = sample()
    x = np.array([features(t, s, base) for t, s, _, base in rows])
    y = np.array([float(v) for _, _, v, _ in rows])
    held = np.arange(len(rows)) % 3 == 0
    trees = Trees(rounds=60, depth=4).fit(x[~held], y[~held])
    raw = trees.raw(x[held])
    a, b = calibrate(raw, y[held])
    p = 1 / (1 + np.exp(-(a * raw + b)))
    of = lambda kind: np.array([s[0] == kind and not base for _, s, _, base in rows])[held]
    return trees, a, b, {k: threshold(p[of(k)], y[held][of(k)], PRECISION) for k in (*KINDS, *MORE)}


#: Of overlapping choices the kind with the stricter format comes first, then the better score.
STRICT = ("iban", "mac", "ipv6", "ssn", "email", "card", "ip", "phone")


Scored = tuple[str, int, int, float, str]


def scored_spans(found: list[list[Span]], texts: list[str], fitted: tuple) -> list[list[Scored]]:
    """Of each text all candidates with their probability and what becomes of them: "base" spans stay whatever it is, "added"
    ones reach the threshold of their kind and overlap neither those nor a better one, "dropped" ones don't."""
    trees, a, b, limits = fitted
    items = [(i, c, True) for i, base in enumerate(found) for c in base]
    for i, (text, base) in enumerate(zip(texts, found)):
        if text and not text.isspace():
            own = set(base)
            items += [(i, c, False) for c in dict.fromkeys(candidates(text)) if c not in own]
    out: list[list[Scored]] = [[] for _ in texts]
    if not items:
        return out
    p = 1 / (1 + np.exp(-(a * trees.raw(np.array([features(texts[i], c, base) for i, c, base in items])) + b)))
    last, taken = -1, []
    rank = [(-1 if base else STRICT.index(c[0])) for _, c, base in items]
    for k in np.lexsort((-p, rank, [i for i, *_ in items])).tolist():
        i, (kind, s, e), base = items[k]
        if i != last:
            last, taken = i, []
        free = base or p[k] >= limits[kind] and not overlaps(taken, s, e)
        if free:
            insort(taken, (s, e))
        out[i].append((kind, s, e, float(p[k]), "base" if base else "added" if free else "dropped"))
    return out


def overlaps(taken: list[tuple[int, int]], s: int, e: int) -> bool:
    """Whether a span meets one of those taken, sorted by start. Base spans may overlap, so ends need not be sorted."""
    i = bisect_left(taken, (e, 0))
    while i > 0:
        i -= 1
        if taken[i][1] > s:
            return True
        if taken[i][0] < s - LONGEST:
            return False
    return False


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


ORDER = {k: i for i, k in enumerate((*KINDS, *MORE))}


def find_pii(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, a count of each base kind, ``base_sha256``, ``spans``, and ``candidates``: every
    span proposed, base ones too, with its probability ``p`` and ``verdict`` (base, added or dropped).

    Offsets count code points, ends are exclusive. Null and empty texts have no spans. Rows correspond one to one, so
    repeated rows repeat their result; ids may be null; an empty table gives an empty result. No shuffle.
    """
    fitted = model()
    kind = df.schema[id].dataType.simpleString()
    schema = f"_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, candidates array<struct<kind:string,start:int,end:int,p:double,verdict:string>>"
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64()), ("verdict", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                scored = [sorted(x, key=lambda s: (ORDER[s[0]], s[1])) for x in scored_spans(base, texts, fitted)]
                counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *counts,
                        pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]),
                        pa.array([joined([s[:3] for s in x if s[4] != "dropped"]) for x in scored]),
                        pa.array([[dict(zip(("kind", "start", "end", "p", "verdict"), s)) for s in x] for x in scored], item),
                    ],
                    names=["_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "candidates"],
                )

    return df.select(F.col(f"`{id}`"), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema).withColumnRenamed("_id", id)


def redact(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and ``redacted``: the text with every span found replaced by its kind in brackets; overlaps fall to the earlier span."""
    fitted = model()
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            out = []
            for t, scored in zip(texts, scored_spans(base, texts, fitted)):
                parts, at = [], 0
                for k, s, e, _, _ in sorted((x for x in scored if x[4] != "dropped"), key=lambda x: (x[1], -x[2])):
                    if s >= at:
                        parts += [t[at:s], f"[{k}]"]
                        at = e
                    elif e > at:  # the rest of an overlapping span goes too
                        at = e
                out.append("".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["_id", "redacted"])

    return df.select(F.col(f"`{id}`"), F.col(f"`{text}`").cast("string")).mapInArrow(run, f"_id {kind}, redacted string").withColumnRenamed("_id", id)
