"""Column expressions: keys, canonical forms, masks, buckets, similarity."""

from __future__ import annotations

import os
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def entity_key(table_id: str, key: Column | str) -> Column:
    """``table_id:key``; a null key gives ``table_id:``."""
    column = F.expr(key) if isinstance(key, str) else key
    return F.concat(F.lit(f"{table_id}:"), F.coalesce(column.cast("string"), F.lit("")))


def source_id(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def source_key(key: Column) -> Column:
    """All that follows the first colon."""
    return F.substr(key, F.instr(key, ":") + 1)


def canonical(value: Column, how: str) -> Column:
    text = value.cast("string")
    return {"LOWERCASE": F.lower(text), "UPPERCASE": F.upper(text), "TRIM": F.trim(text), "DIGITS_ONLY": F.regexp_replace(text, "[^0-9]", "")}.get(how, text)


def mask_pii(value: Column, allowed: bool | None = None) -> Column:
    """Fewer than four characters: stars; else the first two, ``***``, the last two. Null and empty stay."""
    if os.environ.get("PII_ACCESS") == "full" if allowed is None else allowed:
        return value
    n = F.length(value)
    return F.when(value.isNull() | (n == 0), value).when(n < 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(2)), F.lit("***"), F.right(value, F.lit(2))))


def mask_by_role(value: Column, role: str, roles: tuple[str, ...]) -> Column:
    return F.when(F.lit(role in roles), value).otherwise(F.lit("***MASKED***"))


def contains_literal(value: Column, text: str) -> Column:
    """Case-insensitive substring test in which no character is special."""
    return F.contains(F.lower(value), F.lower(F.lit(text)))


#: (upper bound or None, name), by reader. Bounds and names are fixed values.
SIZE_BUCKETS = {
    "health": ((1, "01_singleton"), (5, "02_small (2-5)"), (20, "03_medium (6-20)"), (100, "04_large (21-100)"), (1000, "05_xlarge (101-1000)"), (None, "06_giant (1000+)")),
    "five": ((1, "singleton"), (5, "2-5"), (20, "6-20"), (100, "21-100"), (None, ">100")),
    "dashboard": ((1, "1 (singleton)"), (5, "2-5"), (10, "6-10"), (50, "11-50"), (100, "51-100"), (500, "101-500"), (1000, "501-1000"), (None, "1000+")),
    "quickstart": ((1, "1 (singletons)"), (2, "2 (pairs)"), (5, "3-5 (small)"), (10, "6-10 (medium)"), (None, "11+ (large)")),
    "guide": ((1, "1 (singletons)"), (5, "2-5"), (20, "6-20"), (100, "21-100"), (None, "100+")),
    "scale": ((1, "1 (Singleton)"), (2, "2"), (5, "3-5"), (10, "6-10"), (50, "11-50"), (None, "50+")),
    "power": ((1, "singleton"), (10, "small"), (100, "medium"), (1000, "large"), (None, "GIANT ⚠️")),
}


def bucket(size: Column, spec: str = "five") -> Column:
    return reduce(lambda c, b: c.when(size <= b[0], b[1]) if b[0] else c.otherwise(b[1]), SIZE_BUCKETS[spec][1:], F.when(size <= SIZE_BUCKETS[spec][0][0], SIZE_BUCKETS[spec][0][1]))


def bucket_order(size: Column, spec: str = "five") -> Column:
    return reduce(lambda c, b: c + F.when(size > b[0], 1).otherwise(0) if b[0] else c, SIZE_BUCKETS[spec], F.lit(0))


def severity(size: Column) -> Column:
    return F.when(size > 10_000, "CRITICAL").when(size > 1_000, "WARNING").when(size > 100, "INFO").otherwise("OK")


def normalize_company(name: Column) -> Column:
    """Upper case, without legal suffixes and punctuation, blanks squeezed."""
    bare = F.regexp_replace(F.upper(F.trim(name)), r"[^A-Z0-9 ]", " ")
    bare = F.regexp_replace(bare, r"\b(INC|INCORPORATED|LLC|LTD|LIMITED|CORP|CORPORATION|CO|COMPANY|GMBH|PLC|SA|AG)\b", " ")
    return F.trim(F.regexp_replace(bare, r" +", " "))


def digits_phone(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def hash_share(value: Column) -> Column:
    """A stable number in [0, 1] from the first eight hex digits of the MD5."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def sample_by_hash(df: DataFrame, column: str, rate: float) -> DataFrame:
    """The sampling operator: rows whose stable hash is below ``rate``."""
    return df.where(hash_share(F.col(column)) < rate)


def _jaro_winkler(a: str, b: str, always_boost: bool) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    hit = [False] * len(b)
    first = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not hit[j] and b[j] == x:
                hit[j] = True
                first.append(x)
                break
    if not first:
        return 0.0
    second = [y for y, h in zip(b, hit) if h]
    m = len(first)
    swaps = sum(x != y for x, y in zip(first, second)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro < 0.7 and not always_boost:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


#: Strings up to this length are compared as columns of letters, longer ones one by one; and pairs in one such table.
WIDE = 40
PAIRS = 4096


def _letters(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, a column a place; lengths)."""
    size = np.array([len(v) for v in values])
    out = np.zeros((len(values), max(int(size.max(initial=0)), 1)), dtype=np.uint32)
    for k, v in enumerate(values):
        out[k, : len(v)] = np.frombuffer(v.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return out, size


def _in_front(letters: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The letters at hits, in order, moved to the front; zeros behind them."""
    order = np.argsort(~hit, axis=1, kind="stable")
    return np.where(np.take_along_axis(hit, order, 1), np.take_along_axis(letters, order, 1), 0)


def jaro_winkler_pairs(a: list[str], b: list[str], always_boost: bool) -> np.ndarray:
    """Similarities of many pairs at once: a step for each pair of places, over all pairs of strings."""
    x, n = _letters(a)
    y, m = _letters(b)
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    mine, other = np.zeros(x.shape, dtype=bool), np.zeros(y.shape, dtype=bool)
    for i in range(x.shape[1]):
        far = int(reach.max(initial=0))
        for j in range(max(0, i - far), min(y.shape[1], i + far + 1)):
            new = (x[:, i] == y[:, j]) & ~mine[:, i] & ~other[:, j] & (i < n) & (j < m) & (abs(i - j) <= reach)
            mine[:, i] |= new
            other[:, j] |= new
    hits = mine.sum(axis=1)
    first, second = _in_front(x, mine), _in_front(y, other)
    width = min(first.shape[1], second.shape[1])
    swaps = (first[:, :width] != second[:, :width]).sum(axis=1) // 2
    some = np.maximum(hits, 1)
    jaro = np.where(hits > 0, (hits / np.maximum(n, 1) + hits / np.maximum(m, 1) + (hits - swaps) / some) / 3, 0.0)
    short = min(4, width)
    same = np.logical_and.accumulate((x[:, :short] == y[:, :short]) & (np.arange(short) < np.minimum(n, m)[:, None]), axis=1).sum(axis=1)
    boosted = jaro + 0.1 * same * (1 - jaro)
    return np.where((hits > 0) & (always_boost | (jaro >= 0.7)), boosted, jaro)


def _similarity_udf(always_boost: bool):
    @F.pandas_udf("double")
    def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        found: dict[tuple[str, str], float] = {}  # each pair of values of the batch is compared once
        pairs = [None if x is None or y is None else (x, y) for x, y in zip(a, b)]
        todo = []
        for p in {p for p in pairs if p is not None}:
            if max(len(p[0]), len(p[1])) <= WIDE:
                todo.append(p)
            else:
                found[p] = _jaro_winkler(*p, always_boost)
        todo.sort(key=lambda p: max(len(p[0]), len(p[1])))
        for k in range(0, len(todo), PAIRS):
            part = todo[k : k + PAIRS]
            found.update(zip(part, jaro_winkler_pairs([p[0] for p in part], [p[1] for p in part], always_boost).tolist()))
        return pd.Series([None if p is None else found[p] for p in pairs], dtype="float64")

    return jaro_winkler_similarity


def jaro_winkler(a: Column, b: Column, always_boost: bool = False) -> Column:
    """Null for null, 0 for an empty side; the prefix counts from a Jaro similarity of 0.7 on, or always."""
    return _similarity_udf(always_boost)(a, b)


_VOWELS = set("AEIOU")


def metaphone_code(word: str) -> str:
    """Sound code of an English word after the published Metaphone rules; other characters than letters are dropped."""
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    if w[:2] in ("AE", "GN", "KN", "PN", "WR"):
        w = w[1:]
    elif w[:1] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out, n = [], len(w)
    for i, c in enumerate(w):
        before, after, then = w[i - 1 : i], w[i + 1 : i + 2], w[i + 2 : i + 3]
        if c == before and c != "C":
            continue
        if c in _VOWELS:
            out += [c] * (i == 0)
        elif c == "B":
            out += ["B"] * (not (before == "M" and i == n - 1))
        elif c == "C":
            if after == "I" and then == "A":
                out.append("X")
            elif after == "H":
                out.append("K" if before == "S" else "X")
            elif after in ("I", "E", "Y") and after:
                out += ["S"] * (before != "S")
            else:
                out.append("K")
        elif c == "D":
            out.append("J" if after == "G" and then and then in "EIY" else "T")
        elif c == "G":
            if after == "H" and not (i + 2 < n and then in _VOWELS):
                continue
            if after == "N" and w[i + 1 :] in ("N", "NED"):
                continue
            if before == "D" and after and after in "EIY":
                continue
            out.append("J" if after and after in "EIY" and before != "G" else "K")
        elif c == "H":
            if before and before in "CSPTG":
                continue
            out += ["H"] * (after in _VOWELS and (i == 0 or before not in _VOWELS or after in _VOWELS))
        elif c == "K":
            out += ["K"] * (before != "C")
        elif c == "P":
            out.append("F" if after == "H" else "P")
        elif c == "Q":
            out.append("K")
        elif c == "S":
            out.append("X" if after == "H" or (after == "I" and then and then in "OA") else "S")
        elif c == "T":
            if after == "I" and then and then in "OA":
                out.append("X")
            elif after == "H":
                out.append("T" if then == "M" else "0")
            elif not (after == "C" and then == "H"):
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            out += [c] * (after in _VOWELS)
        elif c == "X":
            out += ["K", "S"]
        elif c == "Z":
            out.append("S")
        else:
            out.append(c)
    return "".join(out)


def _metaphone_udf():
    @F.pandas_udf("string")
    def metaphone(word: pd.Series) -> pd.Series:
        return word.map(metaphone_code, na_action="ignore")

    return metaphone


def metaphone(word: Column) -> Column:
    return _metaphone_udf()(word)


def register(spark: SparkSession) -> None:
    """Make the similarity and sound functions known to SQL expressions of fuzzy rules."""
    spark.udf.register("metaphone", _metaphone_udf())
    for name in ("jaro_winkler_similarity", "jaro_winkler"):
        spark.udf.register(name, _similarity_udf(False))
    spark.udf.register("jaro_winkler_boosted", _similarity_udf(True))


def fuzzy_templates() -> list[dict]:
    """Score templates a user may start from; ``{col}`` is the attribute."""
    return [
        {"id": "exact", "label": "Equal", "sql": "CASE WHEN <a>.{col} = <b>.{col} THEN 1.0 ELSE 0.0 END", "threshold": 1.0},
        {"id": "jaro_winkler", "label": "Jaro-Winkler", "sql": "jaro_winkler_similarity(<a>.{col}, <b>.{col})", "threshold": 0.85},
        {"id": "levenshtein", "label": "Edit distance", "sql": "1.0 - levenshtein(<a>.{col}, <b>.{col}) / greatest(length(<a>.{col}), length(<b>.{col}), 1)", "threshold": 0.8},
        {"id": "metaphone", "label": "Same sound code", "sql": "CASE WHEN metaphone(<a>.{col}) = metaphone(<b>.{col}) THEN 1.0 ELSE 0.0 END", "threshold": 1.0},
        {"id": "soundex", "label": "Sounds alike", "sql": "CASE WHEN soundex(<a>.{col}) = soundex(<b>.{col}) THEN 1.0 ELSE 0.0 END", "threshold": 1.0},
    ]
