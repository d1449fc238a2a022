"""Secret scans: patterns, and the guess cost of values in a credential's context.

Three patterns give the base spans (kinds assign, access, hex). Beyond them, values
that stand where a credential stands (after password, secret, token, pwd, auth, private key and the
like, also within longer names, or in a URL's user part) are kept as kind ``guess`` if they are costly to guess. That cost
is the least, over all ways to cut a whole value into spans, of the sum of the spans'
costs, in powers of ten: words by rank with their spelling variants, dates by the years
they span, repeats by their unit and count, keyboard walks and sequences by start,
length and turns, and any other span by its characters' classes. Words are a few very common
password words and then the whole words of a public tokenizer's vocabulary in its order, which is
about that of their frequency.

The programme takes time in proportion to a value's length, and stops as soon as no way
to go on can be under the threshold.

Spans are in code points with an exclusive end. Defined results: null text is like
empty text and has no span; repeated rows get equal results; no rows give no rows; further
columns are not read by the query and stay as they are in the stage.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinledger.llm.common import table
from kinledger.llm.tokens import blocks
from kinledger.session import ship

#: Kinds in the order that ties of a start are put in.
KINDS = ("assign", "access", "hex", "guess")
#: Powers of ten from which a value counts as a secret, its characters at least, and those of a word at least.
COST, LEAST, WORD = 10.0, 6, 3
REDACTED = "[REDACTED]"
#: The public tokenizer whose words are the dictionary.
WORDS_FILE = "word_bpe_49k.json"

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A credential's name, perhaps with parts after it (SECRET_ACCESS_KEY), and what parts it from its value; a scheme's word is passed over.
_CONTEXT = re.compile(
    r"""(?ai)(?:password|passwd|secret|token|api[_ -]?key|(?<![A-Za-z0-9])(?:pwd|pass(?:phrase|code)?|credentials?|auth(?:orization)?|private[_ -]?key|access[_ -]?key|client[_ -]?key|bearer))"""
    r"""(?:[_-][A-Za-z0-9]{1,24}){0,4}["']?\s{0,4}(?::=|=>|[:=]|\bis\b|\bbearer\b)\s{0,4}["']?(?:(?:bearer|basic|digest|token)\s{1,4}["']?)?(?=[^\s"'<>,;])"""
)
_STOP = re.compile(r"""[\s"'<>,;]""")
#: What may follow a value's first part up to a blank or quote, unless it names another field.
_REST = re.compile(r"""(?a)[<>,;][^\s"'=:]*(?![^\s"'])""")
_URL = re.compile(r"(?a)://[^\s:/@]+:([^\s:/@]+)@")

#: Very common password words by rank, and keyboard rows and sequences.
WORDS = (
    "password love admin welcome monkey dragon letmein master login princess sunshine shadow football baseball secret "
    "test guest root user hello iloveyou trustno passw pass changeme default qwerty summer winter spring autumn "
    "january february march april may june july august september october november december "
    "monday tuesday friday sunday freedom whatever ninja mustang michael jordan superman batman hunter "
    "killer soccer hockey ranger buster thomas robert daniel access flower cookie orange purple "
    "silver golden secure server system oracle example sample temp demo company internet computer"
).split()
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qazwsxedcrfvtgbyhnujm", "1qaz2wsx3edc4rfv", "abcdefghijklmnopqrstuvwxyz")

_PLAIN = str.maketrans("@4310$5!7", "aaeiossit")
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)(?!\d)")
_NEXT = {(a, b) for row in WALKS for a, b in zip(row, row[1:])}
_NEXT |= {(b, a) for a, b in _NEXT}


def _class_size(c: str) -> int:
    if c.isdigit():
        return 10
    return 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100


def vocabulary(path: str) -> list[str]:
    """Whole words of WORD letters a to z or more, of a tokenizer file that marks a word's end, in its order."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    ends = "</w>"
    found = sorted((k, t[: -len(ends)]) for t, k in Tokenizer.from_file(path).get_vocab().items() if t.endswith(ends))
    return [w for _, w in found if len(w) >= WORD and w.isascii() and w.isalpha() and w.islower()]


def _ends(n: int, same) -> list[int]:
    """For each place, where the longest run of places k, k + 1 with ``same(k)`` ends that begins there."""
    out = list(range(1, n + 1))
    for k in range(n - 2, -1, -1):
        if same(k):
            out[k] = out[k + 1]
    return out


class Guesser:
    """Guess costs with a ranked list of words; ``remember`` bounds the short values whose costs are kept."""

    #: Cost of one further span: where it is cut.
    SPAN = math.log10(2)
    #: Walks of up to this length may end anywhere, longer ones where the walk does; repeats have units of 2 to UNITS.
    WALK, UNITS = 12, 8

    def __init__(self, words: list[str], remember: int = 50_000):
        self.rank: dict[str, int] = {}
        for w in words:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank), default=0)
        self.remember, self.known = remember, {}

    def spans(self, value: str) -> Iterator[tuple[float, list[tuple[int, float]]]]:
        """For each place in turn its character's cost by force, and the other spans that begin there as (end, cost)."""
        n = len(value)
        low = value.lower() if len(value.lower()) == n else value
        plain = low.translate(_PLAIN)
        walk = _ends(n, lambda k: (low[k], low[k + 1]) in _NEXT)
        # turns[k]: changes of step up to k, so that a walk's turns are one difference
        turns = [0] * (n + 1)
        for k in range(1, n - 1):
            turns[k + 1] = turns[k] + (abs(ord(low[k + 1]) - ord(low[k])) != abs(ord(low[k]) - ord(low[k - 1])))
        alike = _ends(n, lambda k: value[k] == value[k + 1])
        again = {}
        for unit in range(2, min(self.UNITS, n // 2) + 1):
            run = [0] * (n + 1)
            for k in range(n - unit - 1, -1, -1):
                run[k] = run[k + 1] + 1 if value[k] == value[k + unit] else 0
            again[unit] = run
        force = [math.log10(_class_size(c)) for c in value]
        for i in range(n):
            out = []
            for end in range(i + WORD, min(n, i + self.longest) + 1):
                exact = low[i:end] in self.rank
                word = low[i:end] if exact else plain[i:end]
                if exact or word in self.rank:
                    span = value[i:end]
                    variants = (1 if span == word else 2) * (1 if exact else 4) * (1 if span.lower() in (span, span[0].lower() + span[1:]) else 8)
                    out.append((end, math.log10(self.rank[word] * variants)))
            if m := _DATE.match(value, i):
                out.append((m.end(), math.log10(200 if m.end() - i == 4 else 365 * 200 * (1 if m[0].isdigit() else 4))))
            for end in {*range(i + 3, min(walk[i], i + self.WALK) + 1), walk[i]}:
                if end - i >= 3:
                    out.append((end, math.log10(40 * (end - i)) + 0.3 * (turns[end - 1] - turns[i + 1] > 2)))
            if alike[i] - i >= 3:
                out.append((alike[i], force[i] + math.log10(alike[i] - i)))
            for unit, run in again.items():
                if run[i] >= unit:
                    times = run[i] // unit + 1
                    out.append((i + times * unit, sum(force[i : i + unit]) + math.log10(times)))
            yield force[i], out

    def cost(self, value: str, enough: float = math.inf) -> float:
        """Power of ten of the guesses that the cheapest segmentation takes, or, from ``enough`` on, a number not over it."""
        n = len(value)
        best, open_ = [0.0] + [math.inf] * n, [(0.0, 0)]
        for i, (force, spans) in enumerate(self.spans(value)):
            while open_ and open_[0][1] < i:
                heapq.heappop(open_)
            if open_[0][0] >= enough:  # every way passes one of these places
                return open_[0][0]
            here = best[i] + (self.SPAN if i else 0.0)
            # one character by force; no charge for going on by force, so that such spans have any length
            for end, cost in [(i + 1, best[i] + force), *((end, here + cost) for end, cost in spans)]:
                if cost < best[end]:
                    best[end] = cost
                    heapq.heappush(open_, (cost, end))
        return best[n]

    def costs(self, value: str) -> list[float]:
        """The cost of every suffix of a value, longest first, in one pass."""
        spans = list(self.spans(value))
        n = len(value)
        later, out = [0.0] * (n + 1), [0.0] * n
        for i in range(n - 1, -1, -1):
            force, found = spans[i]
            by_force, by_span = force + later[i + 1], min((cost + later[end] for end, cost in found), default=math.inf)
            out[i], later[i] = min(by_force, by_span), min(by_force, by_span + self.SPAN)
        return out

    def secret(self, value: str) -> bool:
        if len(value) < LEAST:
            return False
        if len(value) > 64:
            return self.cost(value, COST) >= COST
        if value not in self.known:
            if len(self.known) >= self.remember:
                self.known.clear()
            self.known[value] = self.cost(value, COST) >= COST
        return self.known[value]


_READY: dict[str | None, Guesser] = {}


def guesser(words_path: str | None) -> Guesser:
    """One per Python worker; without a tokenizer file the very common words alone are known."""
    if words_path not in _READY:
        _READY[words_path] = Guesser(WORDS + (vocabulary(words_path) if words_path else []))
    return _READY[words_path]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    low, out = text.lower(), []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def _in_context(text: str, guess: Guesser) -> list[tuple[int, int]]:
    """Costly values after a credential's name. A value may hold further names, whose values end where it does."""
    starts: dict[int, list[int]] = {}
    at, end = 0, -1
    while m := _CONTEXT.search(text, at):
        at = m.end()
        if at >= end:
            end = stop.start() if (stop := _STOP.search(text, at)) else len(text)
        starts.setdefault(end, []).append(at)
    out = []
    for end, begins in starts.items():
        first = begins[0]
        ends = [end]
        if (rest := _REST.match(text, end)) and not guess.secret(text[first:end]):
            ends.append(first + len(text[first : rest.end()].rstrip("<>,;.")))
        if any(guess.secret(text[first:e]) for e in ends):
            out += [(first, e) for e in ends if guess.secret(text[first:e])]
        elif len(begins) > 1:
            for e in ends:
                costs = guess.costs(text[first:e])
                out += [(a, e) for a in begins[1:] if e - a >= LEAST and costs[a - first] >= COST]
    return out


def added_spans(text: str, base: list[tuple[int, int, str]], guess: Guesser) -> list[tuple[int, int, str]]:
    """Costly values in a credential's context; of one that base spans cover in part, what they leave."""
    low, out = text.lower(), []
    if any(w in low for w in ("pwd", "pass", "credential", "auth", "key", "bearer", "secret", "token")):
        out += _in_context(text, guess)
    if "://" in text and "@" in text:
        out += [m.span(1) for m in _URL.finditer(text) if guess.secret(m[1])]
    if not out:
        return []
    taken: list[list[int]] = []
    for x, y, _ in sorted(base):
        if taken and x <= taken[-1][1]:
            taken[-1][1] = max(y, taken[-1][1])
        else:
            taken.append([x, y])
    kept: list[tuple[int, int, str]] = []
    free = 0
    for a, b in sorted(set(out), key=lambda s: (s[0], -s[1])):
        if a < free:
            continue
        free = b
        k = max(0, bisect_right(taken, a, key=lambda t: t[0]) - 1)
        while k < len(taken) and taken[k][0] < b:
            if a < taken[k][0]:
                kept.append((a, taken[k][0], "guess"))
            a = max(a, taken[k][1])
            k += 1
        if a < b:
            kept.append((a, b, "guess"))
    return kept


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], REDACTED]
        at = max(at, b)
    return "".join(out) + text[at:]


def scanned(docs: DataFrame, words_path: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in blocks(batch, "text"):
                rows = []
                for text in piece.column("text"):
                    text = text.as_py() or ""
                    base = base_spans(text)
                    more = added_spans(text, base, guesser(words_path))
                    n = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
                    rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more)))
                cols = list(zip(*rows))
                kinds = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"],
                )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scanned(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS_FILE))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every span found is replaced in the text, and n_chars follows; every row stays."""
    import public_tokenizers

    ship(spark)
    names, words_path = docs.columns, public_tokenizers.path(WORDS_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in blocks(batch, "text"):
                texts = []
                for text in piece.column("text").to_pylist():
                    base = base_spans(text or "")
                    found = base + added_spans(text or "", base, guesser(words_path))
                    texts.append(redacted(text, found) if found else text)
                yield piece.set_column(names.index("text"), "text", pa.array(texts, piece.schema.field("text").type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


QUERIES = {"op8_secrets": op8_secrets}
ORACLE: dict[str, str] = {}
