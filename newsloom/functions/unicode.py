"""Compatibility decomposition (NFKD) without combining marks, as native expressions.

The tables come from the Unicode data of Python, built once: characters with one plain character in their place are
translated; those with several (ligatures, fractions, Hangul syllables) are taken place by place, only in texts that hold one.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The combining marks that go.
MARKS = "[̀-ͯ]"
_IS_MARK = range(0x300, 0x370)


@cache
def _tables() -> tuple[str, str, list[tuple[str, str]]]:
    """(characters, their plain ones, [(characters, k-th plain ones)]): in the list, characters without a k-th come last and so are dropped."""
    one, many = [], []
    for code in range(0x110000):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if ord(x) not in _IS_MARK)
        if 0xD800 <= code < 0xE000 or plain == c or code in _IS_MARK:
            continue
        if len(plain) == 1:
            one.append((c, plain))
        else:
            many.append((c, plain))
    # an astral character counts as one for Spark as it does here
    places = []
    for k in range(max(len(p) for _, p in many)):
        own = sorted(many, key=lambda x: len(x[1]) <= k)
        places.append(("".join(c for c, _ in own), "".join(p[k] for _, p in own if len(p) > k)))
    return "".join(c for c, _ in one), "".join(p for _, p in one), places


@cache
def _several() -> str:
    """Ranges of those with several plain characters, or none."""
    codes, ranges = sorted(ord(c) for c in _tables()[2][0][0]), []
    for x in codes:
        if ranges and x == ranges[-1][1] + 1:
            ranges[-1][1] = x
        else:
            ranges.append([x, x])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


def nfkd_fold(c: Column) -> Column:
    """The text decomposed, without combining marks; case stays."""
    chars, plain, places = _tables()
    several = f"[\\x{{80}}-\\x{{10ffff}}&&[{_several()}]]"  # plain letters fail at the first comparison
    expanded = lambda x: F.concat(*(F.translate(x, a, b) for a, b in places))
    runs = F.regexp_extract_all(c, F.lit(f"(?s){several}|(?:(?!{several}).)+"), 0)
    whole = F.when(c.rlike(several), F.array_join(F.transform(runs, lambda x: F.when(x.rlike(several), expanded(x)).otherwise(x)), "")).otherwise(c)
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.regexp_replace(F.translate(whole, chars, plain), MARKS, "")).otherwise(c)
