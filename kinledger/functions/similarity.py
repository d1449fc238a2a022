"""Similarity of names, addresses and identifiers.

Measures that Spark has are Columns. Jaro-Winkler, Ratcliff-Obershelp and what is
made of them are Arrow-batched functions that work each distinct pair of a batch once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinledger.functions.normalize import comparable, stripped

PRIMARY_KEYS = ("ein", "lei", "company_number", "duns", "ssn", "vat", "isin")


def jaro_winkler(a: str, b: str) -> float:
    """Prefix of at most four, scale 0.1, boost above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not used[j] and b[j] == c), None)
        if j is not None:
            used[j] = True
            left.append(c)
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


#: Pairs that are worked together, and characters from which a pair goes alone.
_TOGETHER, _LONG = 4096, 200


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points of each text, filled up with zeros."""
    raw = "".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32).reshape(len(texts), width)


def _met_bits(p: np.ndarray, q: np.ndarray, n: np.ndarray, m: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of both sides that Jaro's measure matches, for texts under 64 codes: a row's second text is a word of bits."""
    wide, one = -(-q.shape[1] // 8) * 8, np.uint64(1)
    raw = np.zeros((*p.shape, 8), np.uint8)
    raw[:, :, : wide // 8] = np.packbits(p[:, :, None] == q[:, None, :], axis=2, bitorder="little")
    equal = np.ascontiguousarray(raw.view("<u8")[:, :, 0].T)
    free, left = np.full(len(p), np.uint64(2**64 - 1)), np.zeros(p.shape, bool)
    for i in range(p.shape[1]):
        high, low = np.minimum(i + reach + 1, m).astype(np.uint64), np.clip(i - reach, 0, 63).astype(np.uint64)
        window = np.where(i < n, ((one << high) - one) & ~((one << low) - one), np.uint64(0))
        may = equal[i] & window & free
        first = may & (~may + one)
        free &= ~first
        left[:, i] = first != 0
    used = np.unpackbits((~free).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return left, used[:, : q.shape[1]].astype(bool)


def jaro_winkler_many(a: list[str], b: list[str]) -> np.ndarray:
    """``jaro_winkler`` of many pairs, place by place of all first texts at once."""
    out = np.fromiter((1.0 if x == y else 0.0 for x, y in zip(a, b)), np.float64, len(a))
    size = np.fromiter((max(len(x), len(y)) for x, y in zip(a, b)), np.int64, len(a))
    open_ = np.flatnonzero(np.fromiter((x != y and x != "" and y != "" for x, y in zip(a, b)), bool, len(a)))
    for k in open_[size[open_] > _LONG].tolist():
        out[k] = jaro_winkler(a[k], b[k])
    open_ = open_[size[open_] <= _LONG]
    open_ = open_[np.argsort(size[open_], kind="stable")]  # pairs of about one length go together
    for at in range(0, len(open_), _TOGETHER):
        rows = open_[at : at + _TOGETHER]
        x, y = [a[k] for k in rows], [b[k] for k in rows]
        n, m = np.array([len(t) for t in x]), np.array([len(t) for t in y])
        p, q = _codes(x, int(n.max())), _codes(y, int(m.max()))
        reach, place = np.maximum(n, m) // 2 - 1, np.arange(q.shape[1])
        line = np.arange(len(rows))
        if max(p.shape[1], q.shape[1]) < 64:
            left, used = _met_bits(p, q, n, m, reach)
        else:
            inside, used, left = place < m[:, None], np.zeros(q.shape, bool), np.zeros(p.shape, bool)
            for i in range(p.shape[1]):
                may = (q == p[:, i : i + 1]) & inside & ~used & (np.abs(place - i) <= reach[:, None]) & (i < n)[:, None]
                first = may.argmax(1)
                hit = may[line, first]
                used[line[hit], first[hit]] = True
                left[:, i] = hit
        same = left.sum(1)
        # both have a row's matched codes in order, and as many
        apart = np.bincount(np.repeat(line, same), p[left] != q[used], len(rows)).astype(np.int64)
        swaps, some = apart // 2, np.maximum(same, 1)
        jaro = np.where(same > 0, (same / n + same / m + (same - swaps) / some) / 3, 0.0)
        width = min(4, p.shape[1], q.shape[1])
        alike = (p[:, :width] == q[:, :width]) & (np.arange(width) < np.minimum(n, m)[:, None])
        prefix = np.cumprod(alike, axis=1).sum(1)
        out[rows] = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
    return out


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp; the order of the arguments matters, and long texts skip popular characters."""
    if a == b and len(a) < 200:
        return 1.0
    return SequenceMatcher(None, a, b).ratio()


def _paired(f: Callable, kind: str) -> Callable:
    """``f`` of two strings as a batched function; null counts as empty."""

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        met: dict = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna("")):
            if pair not in met:
                met[pair] = f(*pair)
            out.append(met[pair])
        return pd.Series(out, dtype="object" if kind.startswith("array") or kind == "string" else None)

    return run


#: Ratios of a worker's last pairs of short texts, up to a number of them.
_MET: dict[tuple[str, str], float] = {}
_MOST_MET = 200_000


def _ratio_many(a: list[str], b: list[str]) -> np.ndarray:
    out = np.zeros(len(a))
    for k, pair in enumerate(zip(a, b)):
        got = _MET.get(pair)
        if got is None:
            got = ratio(*pair)
            if len(pair[0]) + len(pair[1]) < _LONG:
                if len(_MET) >= _MOST_MET:
                    _MET.clear()
                _MET[pair] = got
        out[k] = got
    return out


#: Pairs of bits that are worked together: little enough to stay in a processor's cache.
_AT_ONCE = 8192
_BELOW = np.array([(1 << k) - 1 for k in range(65)], np.uint64)


def _bits(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of each text's characters, from 1, and by text and number the places where it has that character; texts under 64 characters."""
    raw = _codes(texts, max(map(len, texts), default=0))
    known, codes = np.unique(np.append(raw, np.uint32(0)), return_inverse=True)
    codes = codes[:-1].reshape(raw.shape)
    inside = np.arange(raw.shape[1]) < np.array([len(t) for t in texts], np.int64)[:, None]
    codes = np.where(inside, codes + 1, 0)
    at = np.zeros((len(texts), len(known) + 1), np.uint64)
    line = np.arange(len(texts))
    for k in range(raw.shape[1]):
        at[line, codes[:, k]] |= np.uint64(1 << k)
    at[:, 0] = 0
    return codes.astype(np.int32), at


def _among(texts: list[str], i: np.ndarray, j: np.ndarray, alone: Callable, together: Callable) -> np.ndarray:
    """A measure of texts i and j: ``together`` of those of 1 to 63 characters, ``alone`` of each other pair."""
    size = np.array([len(t) for t in texts], np.int64)
    fit = (size > 0) & (size < 64)
    out, easy = np.zeros(len(i)), fit[i] & fit[j]
    for k in np.flatnonzero(~easy).tolist():
        out[k] = alone(texts[i[k]], texts[j[k]])
    codes, at = _bits([t if f else "" for t, f in zip(texts, fit.tolist())])
    todo = np.flatnonzero(easy)
    for k in range(0, len(todo), _AT_ONCE):
        rows = todo[k : k + _AT_ONCE]
        a, b = i[rows], j[rows]
        out[rows] = together(codes, at, size, a, b)
    return out


def _jaro_winkler_bits(codes: np.ndarray, at: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n, m = size[a], size[b]
    p, q = codes[a, : n.max()], codes[b, : m.max()]
    reach, one = np.maximum(n, m) // 2 - 1, np.uint64(1)
    flat, base, lines = at.ravel(), b * at.shape[1], np.ascontiguousarray(p.T)
    free, left = _BELOW[m], np.zeros(lines.shape, bool)
    # places before the end and before the begin of what a character may meet
    high, low = _BELOW[reach + 1], np.zeros(len(a), np.uint64)
    for k, line in enumerate(lines):
        may = flat[base + line] & high & ~low & free
        first = may & (~may + one)
        free ^= first
        np.not_equal(first, 0, out=left[k])
        high, low = (high << one) | one, (low << one) | (k >= reach)
    left = np.ascontiguousarray(left.T)
    used = (_BELOW[m] & ~free).astype("<u8").view(np.uint8).reshape(-1, 8)
    used = np.unpackbits(used, axis=1, bitorder="little")[:, : q.shape[1]].astype(bool)
    same = left.sum(1)
    apart = np.bincount(np.repeat(np.arange(len(a)), same), p[left] != q[used], len(a)).astype(np.int64)
    swaps, some = apart // 2, np.maximum(same, 1)
    jaro = np.where(same > 0, (same / n + same / m + (same - swaps) / some) / 3, 0.0)
    width = min(4, p.shape[1], q.shape[1])
    prefix = np.cumprod((p[:, :width] == q[:, :width]) & (p[:, :width] > 0), axis=1).sum(1)
    return np.where(a == b, 1.0, np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro))


def jaro_winkler_among(texts: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``jaro_winkler`` of the distinct texts' numbers i and j."""
    return _among(texts, i, j, lambda a, b: float(jaro_winkler_many([a], [b])[0]), _jaro_winkler_bits)


def _levenshtein_bits(codes: np.ndarray, at: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edits by columns of bits (Myers): those of the second text are worked at once."""
    n, m = size[a], size[b]
    one, high = np.uint64(1), np.uint64(1) << (m - 1).astype(np.uint64)
    flat, base, lines = at.ravel(), b * at.shape[1], np.ascontiguousarray(codes[a, : n.max()].T)
    more, less, edits = np.full(len(a), np.uint64(2**64 - 1)), np.zeros(len(a), np.uint64), m.copy()
    for k, line in enumerate(lines):
        equal = flat[base + line]
        down = equal | less
        across = (((equal & more) + more) ^ more) | equal
        up, off = less | ~(across | more), more & across
        edits += np.where(k < n, ((up & high) != 0).astype(np.int64) - ((off & high) != 0), 0)
        up, off = (up << one) | one, off << one
        more, less = off | ~(down | up), up & down
    return edits.astype(np.float64)


def _levenshtein(a: str, b: str) -> int:
    row = np.arange(len(b) + 1)
    text = np.array([ord(c) for c in b], np.int64)
    for k, c in enumerate(a, 1):
        low = np.minimum(row[:-1] + (text != ord(c)), row[1:] + 1)
        # an insertion moves along the row
        row = np.minimum.accumulate(np.append(k, low) - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
    return int(row[-1])


def levenshtein_among(texts: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Edits between the texts of numbers i and j."""
    return _among(texts, i, j, _levenshtein, _levenshtein_bits)


def ratio_among(texts: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return _ratio_many([texts[k] for k in i.tolist()], [texts[k] for k in j.tolist()])


_BLANKS = re.compile(r"\s+", re.ASCII)


def name_similarity_among(names: list[str | None], i: np.ndarray, j: np.ndarray, metric: str = "jw4") -> np.ndarray:
    """``name_similarity`` of the distinct names' numbers i and j; names are in lower case and stripped, and None where there is none."""
    said = [t or "" for t in names]
    words = [{w for w in _BLANKS.split(t) if w} for t in said]
    joined = [" ".join(sorted(w for w in _BLANKS.split(t) if w)) for t in said]
    pairs = list(zip(i.tolist(), j.tolist()))
    jaccard = np.array([len(words[a] & words[b]) / len(words[a] | words[b]) if words[a] and words[b] else 0.0 for a, b in pairs], np.float64)
    turned = ratio_among(joined, i, j)
    if metric == "jw4":
        longest = np.maximum(*(np.array([len(t) for t in said], np.int64)[k] for k in (i, j)))
        near = np.where(longest == 0, 0.0, 1.0 - levenshtein_among(said, i, j) / np.maximum(longest, 1))
        total = 0.3 * jaro_winkler_among(said, i, j) + 0.2 * near + 0.3 * jaccard + 0.2 * turned
    else:
        total = (ratio_among(said, i, j) + jaccard + turned) / 3.0
    none = np.array([t is None for t in names], bool)
    return np.where(none[i] | none[j], 0.0, np.where(i == j, 1.0, np.clip(total, 0.0, 1.0)))


def _coded(a: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = pc.fill_null(a.cast(pa.large_string()), "").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _distinct(a: pa.Array, b: pa.Array, many: Callable) -> np.ndarray:
    """``many`` of two arrays of texts, of each distinct pair once; null counts as empty."""
    if not len(a):
        return np.zeros(0)
    (i, x), (j, y) = _coded(a), _coded(b)
    some, back = np.unique(i * len(y) + j, return_inverse=True)
    first, second = np.divmod(some, len(y))
    return many([x[k] for k in first.tolist()], [y[k] for k in second.tolist()])[back]


def _best(a: pa.ListArray, b: pa.ListArray, many: Callable) -> np.ndarray:
    """The largest of ``many`` over all pairs of two lists' texts, 0 if a list is null or empty."""
    size = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (a, b)]
    flat, n = [c.flatten() for c in (a, b)], size[0] * size[1]
    begin, ends, best = [np.cumsum(x) - x for x in size], np.cumsum(n), np.zeros(len(a))
    row = np.repeat(np.arange(len(a)), n)
    nth = np.arange(len(row)) - np.repeat(ends - n, n)
    i, j = begin[0][row] + nth // size[1][row], begin[1][row] + nth % size[1][row]
    some = np.flatnonzero(n)
    if len(some):
        best[some] = np.maximum.reduceat(_distinct(flat[0].take(pa.array(i)), flat[1].take(pa.array(j)), many), (ends - n)[some])
    return best


def jaro_winkler_col(a: Column, b: Column) -> Column:
    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(_distinct(a, b, jaro_winkler_many), pa.float64())

    return run(a, b)


def ratio_col(a: Column, b: Column) -> Column:
    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(_distinct(a, b, _ratio_many), pa.float64())

    return run(a, b)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def _tokens(c: Column) -> Column:
    return F.filter(F.split(stripped(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != "")


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct words; 0 if either text has none."""
    x, y = F.array_distinct(_tokens(a)), F.array_distinct(_tokens(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(_tokens(c)), " ")


def token_sort(a: Column, b: Column) -> Column:
    return ratio_col(sorted_tokens(a), sorted_tokens(b))


def compared_name(c: Column) -> Column:
    """A name as its similarity is made of, null where there is none."""
    return F.when(F.coalesce(c, F.lit("")) != "", stripped(F.lower(c)))


def name_similarity(a: Column, b: Column, metric: str = "jw4") -> Column:
    """jw4: 0.3 Jaro-Winkler + 0.2 Levenshtein + 0.3 words + 0.2 sorted words; sm3: mean of ratio, words, sorted words."""
    x, y = stripped(F.lower(F.coalesce(a, F.lit("")))), stripped(F.lower(F.coalesce(b, F.lit(""))))
    if metric == "jw4":
        total = 0.3 * jaro_winkler_col(x, y) + 0.2 * levenshtein_similarity(x, y) + 0.3 * token_jaccard(x, y) + 0.2 * token_sort(x, y)
    else:
        total = (ratio_col(x, y) + token_jaccard(x, y) + token_sort(x, y)) / 3.0
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(empty, F.lit(0.0)).when(x == y, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def address_similarity(a: Column, b: Column, metric: str = "jw4") -> Column:
    """Best of all pairs of addresses; 0 if either list is empty, 1 without a comparison if they share one."""
    many = jaro_winkler_many if metric == "jw4" else _ratio_many

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(_best(a, b, many), pa.float64())

    plain = lambda c: F.transform(c, comparable)
    x, y = plain(a), plain(b)
    shared = F.coalesce(F.arrays_overlap(x, y), F.lit(False))
    none = F.array().cast("array<string>")
    return F.when(shared, F.lit(1.0)).otherwise(run(F.when(~shared, x).otherwise(none), y))


def identifier_match(a: Column, b: Column) -> Column:
    """1 for an equal primary identifier, 0.5 for another equal one, 0 otherwise; null equals null."""
    keys = F.array(*[F.lit(k) for k in PRIMARY_KEYS])
    has = lambda m, k: F.coalesce(F.map_contains_key(m, k), F.lit(False))
    same = lambda k: has(a, k) & has(b, k) & F.element_at(a, k).eqNullSafe(F.element_at(b, k))
    shared = F.array_except(F.array_intersect(F.map_keys(a), F.map_keys(b)), keys)
    return F.when(F.exists(keys, same), F.lit(1.0)).when(F.coalesce(F.exists(shared, same), F.lit(False)), F.lit(0.5)).otherwise(F.lit(0.0))


def potential_match(a: Column, b: Column, threshold: float = 0.8) -> Column:
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return (stripped(low(a)) == stripped(low(b))) | (ratio_col(low(a), low(b)) >= threshold)


def common_substrings(a: Column, b: Column, least: int = 3) -> Column:
    """Matching blocks of the lower-cased texts, cut from the first text as it is."""
    def blocks(x: str, y: str) -> list[str]:
        found = SequenceMatcher(None, x.lower(), y.lower()).get_matching_blocks()
        return [x[m.a : m.a + m.size] for m in found if m.size >= least]

    return _paired(blocks, "array<string>")(a, b)


def longest_common_substring(a: Column, b: Column) -> Column:
    def longest(x: str, y: str) -> str:
        m = SequenceMatcher(None, x.lower(), y.lower()).find_longest_match(0, len(x), 0, len(y))
        return x[m.a : m.a + m.size]

    return _paired(longest, "string")(a, b)


def soundex(c: Column) -> Column:
    return F.soundex(F.coalesce(c, F.lit("")))


def phonetic_match(a: Column, b: Column) -> Column:
    return soundex(a) == soundex(b)


def soundex_simple(c: Column) -> Column:
    """The variant that compares with the last emitted digit only and knows no vowel reset."""
    codes = F.translate(F.upper(F.coalesce(c, F.lit(""))), "BFPVCGJKQSXZDTLMNRAEIOUYHW", "11112222222233455600000000")
    digits = F.filter(F.split(F.substring(codes, 2, 1000), ""), lambda x: x.between("1", "6"))
    last = lambda acc: F.substring(acc, -1, 1)
    joined = F.aggregate(digits, F.upper(F.substring(F.coalesce(c, F.lit("")), 1, 1)), lambda acc, x: F.when(last(acc) == x, acc).otherwise(F.concat(acc, x)))
    return F.when(joined == "", "").otherwise(F.substring(F.rpad(joined, 4, "0"), 1, 4))


def metaphone_of(text: str) -> str:
    """Sound key of an English word by the published consonant rules."""
    s = "".join(c for c in text.upper() if c.isalpha())
    for head, to in (("KN", "N"), ("GN", "N"), ("PN", "N"), ("AE", "E"), ("WR", "R"), ("X", "S"), ("WH", "W")):
        if s.startswith(head):
            s = to + s[len(head) :]
            break
    out, i = [], 0
    at = lambda k: s[k] if 0 <= k < len(s) else ""
    while i < len(s):
        c, after = s[i], at(i + 1)
        if c == at(i - 1) and c != "C":
            i += 1
            continue
        if c in "AEIOU":
            out.append(c if i == 0 else "")
        elif c == "B":
            out.append("" if at(i - 1) == "M" and i == len(s) - 1 else "B")
        elif c == "C":
            if after == "H" or s[i : i + 3] == "CIA":
                out.append("X")
                i += after == "H"
            else:
                out.append("S" if after and after in "IEY" else "K")
        elif c == "D":
            out.append("J" if after == "G" and at(i + 2) and at(i + 2) in "EIY" else "T")
        elif c == "G":
            silent = (after == "H" and not (at(i + 2) and at(i + 2) in "AEIOU")) or (after == "N" and i + 2 >= len(s))
            out.append("" if silent else "J" if after and after in "EIY" and at(i - 1) != "G" else "K")
        elif c == "H":
            out.append("H" if after and after in "AEIOU" and not (at(i - 1) and at(i - 1) in "CSPTG") else "")
        elif c == "K":
            out.append("" if at(i - 1) == "C" else "K")
        elif c == "P":
            out.append("F" if after == "H" else "P")
        elif c == "Q":
            out.append("K")
        elif c == "S":
            sh = after == "H" or s[i : i + 3] in ("SIO", "SIA")
            out.append("X" if sh else "S")
        elif c == "T":
            if after == "H":
                out.append("0")
                i += 1
            else:
                out.append("X" if s[i : i + 3] in ("TIA", "TIO") else "" if s[i : i + 3] == "TCH" else "T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            out.append(c if after and after in "AEIOU" else "")
        elif c == "X":
            out.append("KS")
        elif c == "Z":
            out.append("S")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def metaphone(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.fillna("").map(metaphone_of)

    return run(c)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def distance(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """Euclidean, with eps added to each difference."""
    gap = lambda p, q: p.cast("double") - q.cast("double") + F.lit(eps)
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: gap(p, q) * gap(p, q)), F.lit(0.0), lambda s, v: s + v))
