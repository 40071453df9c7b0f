"""Secrets: exact base patterns, and further spans by grammar inference.

From labelled credentials (seeded samples of public formats, none of them real) a prefix tree of symbol classes is
built for each format, and states whose continuations are statistically compatible (ALERGIA, Hoeffding's bound on every
transition, recursively) are merged into a probabilistic automaton. A candidate, any run of SHORTEST or more token characters and any base span, is
scored by its best log likelihood under the automata, less that of what is no credential: a background model of words,
numbers, paths and names, and automata of checksums and identifiers. The threshold keeps the wanted precision on a held-out
part, and is at least the logarithm of how rare credentials are.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.textbytes import as_bytes

ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
#: Least length of a candidate, and scores kept by a task.
SHORTEST, CACHED = 12, 200_000
TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{{{SHORTEST},}}")
#: Share of credentials wanted among what is told as one on the held-out part, and ordinary tokens for each credential elsewhere.
PRECISION, ODDS = 0.98, 10_000
LEAST_COUNT = 4.0
ALPHA = 0.05

TOKEN_BYTE = np.zeros(256, bool)
TOKEN_BYTE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-")] = True

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The base patterns, by start and then kind."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def symbol(c: str) -> str:
    """A character's class: digit, hex letter, other letter (by case), or the character itself."""
    if "0" <= c <= "9":
        return "0"
    if "a" <= c <= "f":
        return "a"
    if "A" <= c <= "F":
        return "A"
    return "g" if "g" <= c <= "z" else "G" if "G" <= c <= "Z" else c


CLASSES = {ord(c): symbol(c) for c in map(chr, range(33, 127))}


class Automaton:
    """A probabilistic automaton by state merging on the prefix tree of ``strings``."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.total, self.stop, self.count, self.next = [0], [0], [Counter()], [{}]
        for s in strings:
            at = 0
            self.total[0] += 1
            for c in s:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.total)
                    self.total.append(0)
                    self.stop.append(0)
                    self.count.append(Counter())
                    self.next.append({})
                self.count[at][c] += 1
                at = self.next[at][c]
                self.total[at] += 1
            self.stop[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total[a], self.total[b]
            if not n or not m:
                continue
            if self._differ(self.stop[a], n, self.stop[b], m):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a][c], n, self.count[b][c], m):
                    return False
                if c in self.next[a] and c in self.next[b] and min(n, m) >= LEAST_COUNT:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _likelihood(self, into: int, a: int) -> float:
        """Log likelihood of the strings below ``a`` as continuations of ``into``: few strings are compatible with too many states."""
        out, todo = 0.0, [(into, a)]
        while todo:
            into, a = todo.pop()
            n, count, step = self.total[into] + 0.4, self.count[into], self.next[into]
            if self.stop[a]:
                out += self.stop[a] * math.log((self.stop[into] + 0.02) / n)
            for c, b in self.next[a].items():
                out += self.count[a][c] * math.log((count[c] + 0.02) / n)
                todo.append((step.get(c, into), b))
        return out

    def _fold(self, into: int, a: int) -> None:
        todo = [(into, a)]
        while todo:
            into, a = todo.pop()
            self.total[into] += self.total[a]
            self.stop[into] += self.stop[a]
            self.count[into] += self.count[a]
            for c, b in self.next[a].items():
                if c in self.next[into]:
                    if self.next[into][c] != b:
                        todo.append((self.next[into][c], b))
                else:
                    self.next[into][c] = b

    def _merge(self) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            parent, c = blue.pop(0)
            b = self.next[parent].get(c)
            if b is None or b in red:
                continue
            fits = [r for r in red if self._compatible(r, b)]
            if fits:
                r = max(fits, key=lambda r: self._likelihood(r, b))
                self.next[parent][c] = r
                self._fold(r, b)
                blue += [(r, x) for x in sorted(self.next[r]) if self.next[r][x] not in red and (r, x) not in blue]
            else:
                red.append(b)
                blue += [(b, x) for x in sorted(self.next[b])]
        self.states = len(red)

    def score(self, s: str) -> float:
        """Log likelihood of a string of classes; what was never seen in a state costs, and leaves it there."""
        at, out = 0, 0.0
        for c in s:
            n = self.total[at] + 20 * 0.02
            out += math.log((self.count[at][c] + 0.02) / n)
            nxt = self.next[at].get(c)
            if nxt is None:
                out -= 1.0  # never seen here: stay
            else:
                at = nxt
        return out + math.log((self.stop[at] + 0.02) / (self.total[at] + 0.4))


def credentials(n: int = 150, seed: int = 5) -> dict[str, list[str]]:
    """Invented credentials of public formats."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    up, low, num = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = up + low + num
    made = {
        "github": lambda: r.choice(("ghp_", "gho_", "ghs_")) + pick(mixed, 36),
        "slack": lambda: r.choice(("xoxb-", "xoxp-")) + pick(num, 11) + "-" + pick(num, 12) + "-" + pick(mixed, 24),
        "live": lambda: r.choice(("sk_live_", "pk_live_", "rk_live_")) + pick(mixed, 24),
        "jwt": lambda: "eyJ" + pick(mixed, 33) + "." + "eyJ" + pick(mixed, 50) + "." + pick(mixed + "_-", 43),
        "cloud": lambda: "AIza" + pick(mixed + "_-", 35),
        "key": lambda: pick(mixed + "+/", r.randint(24, 60)),
        "plain": lambda: pick(mixed, r.randint(20, 40)),
        "base64": lambda: pick(mixed + "+/", 42) + "==",
        "upperhex": lambda: pick("0123456789ABCDEF", 32),
        "marked": lambda: pick(low, r.randint(2, 6)) + r.choice("_-") + pick(mixed, r.randint(20, 44)),
        "sectioned": lambda: pick(up, 2) + "." + pick(mixed + "_-", 22) + "." + pick(mixed + "_-", 43),
    }
    return {k: [f() for _ in range(n)] for k, f in made.items()}


SYLLABLES = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "st", "ing", "tion", "heit", "ment", "cion", "bra", "ki", "qu", "wo", "ly", "vu", "ze", "x", "y")


def ordinary(n: int = 3000, seed: int = 6) -> list[str]:
    """Long tokens that are no credentials: words, numbers, paths, names, dates, versions, identifiers, checksums."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(2, 5)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    made = [
        lambda: "".join(word() for _ in range(3)), lambda: "".join(word() for _ in range(3)).upper(), lambda: num(r.randint(12, 24)), lambda: "/".join(word() for _ in range(4)), lambda: "_".join(word() for _ in range(3)), lambda: "-".join(word() for _ in range(4)), lambda: ".".join(word() for _ in range(3)) + ".com", lambda: word() + word(),
        lambda: f"20{num(2)}-0{num(1)}-1{num(1)}-{word()}-{num(4)}", lambda: f"{word()}{word()}-{num(1)}.{num(2)}.{num(1)}.tar.gz", lambda: "".join(word().title() for _ in range(r.randint(2, 5))) + r.choice(("", num(1), num(2), num(3))), lambda: word() + "".join(word().title() for _ in range(r.randint(2, 4))) + r.choice(("", num(2))), lambda: word() + word() + word() + num(r.randint(1, 4)),
        lambda: "=" * r.randint(12, 40), lambda: "-" * r.randint(12, 40), lambda: "." * r.randint(12, 60), lambda: f"{num(3)}.{num(3)}.{num(3)}.{num(3)}.{num(2)}", lambda: f"{word()}_{word().upper()}_{num(r.randint(1, 8))}",
        lambda: "/".join(r.choice((word(), word().title(), num(r.randint(1, 6)))) for _ in range(r.randint(3, 6))) + r.choice((".html", ".py", ".png", "")), lambda: f"{word().title()}.{word()}.{word().title()}{word().title()}", lambda: f"{word()}={word()}{num(3)}", lambda: f"{num(4)}-{num(2)}-{num(2)}T{num(2)}.{num(2)}.{num(2)}",
    ]
    out = []
    while len(out) < n:
        if len(s := r.choice(made)()) >= SHORTEST:
            out.append(s)
    return out


def lookalikes(n: int = 300, seed: int = 7) -> dict[str, list[str]]:
    """Random strings that are no credentials: checksums of packages and identifiers of rows."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    made = {
        "sha1": lambda: "sha1-" + pick(b64, 27) + "=",
        "sha256": lambda: "sha256-" + pick(b64, 43) + "=",
        "sha512": lambda: "sha512-" + pick(b64, 86) + "==",
        "uuid": lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)),
        "time": lambda: f"20{pick('0123456789', 6)}_{pick('0123456789', 6)}",
    }
    return {k: [f() for _ in range(n)] for k, f in made.items()}


class Model:
    def __init__(self) -> None:
        good = {k: [s.translate(CLASSES) for s in v] for k, v in credentials().items()}
        bad = [s.translate(CLASSES) for s in ordinary()]
        alike = {k: [s.translate(CLASSES) for s in v] for k, v in lookalikes().items()}
        self.automata = {k: Automaton(v[::3] + v[1::3]) for k, v in good.items()}
        self.others = {k: Automaton(v[::3] + v[1::3]) for k, v in alike.items()}
        self.after: dict[str, Counter] = {}  # symbols by the two before
        for s in bad[::2]:
            for i, c in enumerate(s):
                self.after.setdefault(("^^" + s)[i : i + 2], Counter())[c] += 1
        self.seen = {k: sum(v.values()) for k, v in self.after.items()}
        self.cache: dict[str, float] = {}
        scores = [(self.score(s), 1) for v in good.values() for s in v[2::3]] + [(self.score(s), 0) for s in [*bad[1::2], *(x for v in alike.values() for x in v[2::3])]]
        scores.sort(key=lambda x: -x[0])
        self.limit, hits = math.inf, 0
        for i, (s, y) in enumerate(scores):
            hits += y
            if hits / (i + 1) >= PRECISION:
                self.limit = s
        self.limit = max(self.limit, math.log(ODDS))

    def background(self, s: str) -> float:
        out, none = 0.0, Counter()
        for i, c in enumerate(s):
            two = ("^^" + s)[i : i + 2]
            out += math.log((self.after.get(two, none)[c] + 0.2) / (self.seen.get(two, 0) + 4.0))
        return out

    def against(self, s: str) -> float:
        """Log likelihood of what is no credential: ordinary tokens, or one of the formats of checksums and identifiers."""
        return max(self.background(s), *(a.score(s) for a in self.others.values()))

    def score(self, classes: str) -> float:
        """Log likelihood ratio of a credential."""
        if classes not in self.cache:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            self.cache[classes] = max(a.score(classes) for a in self.automata.values()) - self.against(classes)
        return self.cache[classes]


@lru_cache(1)
def model() -> Model:
    return Model()


Scored = tuple[str, int, int, float, str]


def scored_spans(text: str, base: list[Span], fitted: Model) -> list[Scored]:
    """Base spans, and all runs of SHORTEST and more token characters, with their log likelihood ratio and what becomes
    of them: "base" spans stay whatever it is, "added" ones reach the limit and overlap none of those, "dropped" ones don't."""
    out: list[Scored] = [(k, a, b, fitted.score(text[a:b].translate(CLASSES)), "base") for k, a, b in base]
    spans = sorted((a, b) for _, a, b in base)
    i = 0
    reach = 0  # base spans from i on start after the token; the others reach so far
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in ".-=" and (text[b - 1] != "=" or b - a > 2 and text[b - 3] == "="):  # the end of a sentence or a rule is no part of a token
            b -= 1
        if b - a < SHORTEST:
            continue
        while i < len(spans) and spans[i][0] < b:
            reach = max(reach, spans[i][1])
            i += 1
        score = fitted.score(text[a:b].translate(CLASSES))
        out.append(("token", a, b, score, "added" if score >= fitted.limit and reach <= a else "dropped"))
    return out


def worth(column: pa.Array) -> np.ndarray:
    """Rows in which a candidate can be: an assignment sign, AKIA's letters, or a long token. Exact, by bytes."""
    b, o = as_bytes(column)
    n = len(o) - 1
    edges = np.concatenate([[-1], np.flatnonzero(~TOKEN_BYTE[b]), [len(b)]])
    edges = np.unique(np.concatenate([edges, o[1:-1] - 0.5]))  # texts end tokens too
    starts = np.ceil(edges[:-1] + 0.5).astype(np.int64)
    ends = np.floor(edges[1:] + 0.5).astype(np.int64)
    out = np.zeros(n, bool)
    out[np.searchsorted(o, starts[ends - starts >= SHORTEST], "right") - 1] = True
    sign = np.flatnonzero((b == 61) | (b == 58))
    out[np.searchsorted(o, sign, "right") - 1] = True
    upper = np.flatnonzero((b[:-1] == 75) & (b[1:] == 73)) if len(b) > 1 else np.zeros(0, np.int64)  # KI
    out[np.searchsorted(o, upper, "right") - 1] = True
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


NOTHING = hashlib.sha256(b"").hexdigest()
ORDER = {k: i for i, k in enumerate((*KINDS, "token"))}


def find_secrets(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, a count of each base kind, ``base_sha256``, ``spans``, and ``candidates``: base spans and every
    run of SHORTEST and more token characters, with its ``score`` (log likelihood ratio) and ``verdict`` (base, added or dropped).

    Offsets count code points, ends are exclusive; spans stand by start and then kind. Null and empty texts have none.
    Rows correspond one to one, so repeated rows repeat their result; ids may be null; an empty table gives an empty
    result. No shuffle.
    """
    fitted = model()
    kind = df.schema[id].dataType.simpleString()
    schema = f"_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, candidates array<struct<kind:string,start:int,end:int,score:double,verdict:string>>"
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("verdict", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                go = np.flatnonzero(worth(part.column(1)))
                base: list[list[Span]] = [[] for _ in range(part.num_rows)]
                every: list[list[Scored]] = [[] for _ in range(part.num_rows)]
                for k in go.tolist():
                    t = part.column(1)[k].as_py()
                    base[k] = base_spans(t)
                    every[k] = sorted(scored_spans(t, base[k], fitted), key=lambda s: (s[1], ORDER[s[0]]))
                counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array([hashlib.sha256(joined(b).encode()).hexdigest() if b else NOTHING for b in base]), pa.array([joined([x[:3] for x in b if x[4] != "dropped"]) for b in every]), pa.array([[dict(zip(("kind", "start", "end", "score", "verdict"), x)) for x in b] for b in every], item)],
                    names=["_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "candidates"],
                )

    return df.select(F.col(f"`{id}`"), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema).withColumnRenamed("_id", id)
