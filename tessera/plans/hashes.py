"""Spark's xxhash64 of a short text, as SQL, to hold splits against.

The constants are the algorithm's (fixed values); texts of up to 15 bytes.
"""

from __future__ import annotations

_P = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_ALL = 18446744073709551616


def _times(a: str, b: int) -> str:
    return f"(({a})::UHUGEINT * {b}::UHUGEINT % {_ALL}::UHUGEINT)"


def _plus(a: str, b: int) -> str:
    return f"(({a})::UHUGEINT + {b}::UHUGEINT) % {_ALL}::UHUGEINT"


def _turned(a: str, by: int) -> str:
    return f"(({a})::UHUGEINT * {1 << by}::UHUGEINT % {_ALL}::UHUGEINT + ({a})::UHUGEINT // {1 << (64 - by)}::UHUGEINT)"


def _xor(a: str, b: str) -> str:
    return f"xor(CAST({a} AS UBIGINT), CAST({b} AS UBIGINT))"


def xxhash_ctes(source: str, column: str, keep: str, seed: int = 42) -> str:
    """Common table expressions whose last, ``hashed``, holds keep and the signed hash h of a text column of source."""
    word = lambda first, n: " + ".join(f"ascii(s[{first} + {i}])::UHUGEINT * {256 ** i}::UHUGEINT" for i in range(n))
    lane = _times(_turned(_times(word("1", 8), _P[1]), 31), _P[0])
    eight = _plus(_times(_turned(_xor("h", lane), 27), _P[0]), _P[3])
    four = _plus(_times(_turned(_xor("h", _times(word("pos", 4), _P[0])), 23), _P[1]), _P[2])
    one = _times(_turned(_xor("h", _times("ascii(s[pos])", _P[4])), 11), _P[0])
    steps = [
        f"x0 AS (SELECT {keep}, s, len(s) AS n, 1 AS pos, {_plus(f'{seed + _P[4]} + len(s)', 0)} AS h FROM (SELECT {keep}, {column} AS s FROM {source}))",
        f"x1 AS (SELECT {keep}, s, n, CASE WHEN n >= 8 THEN 9 ELSE pos END AS pos, CASE WHEN n >= 8 THEN {eight} ELSE h END AS h FROM x0)",
        f"x2 AS (SELECT {keep}, s, n, CASE WHEN n - pos >= 3 THEN pos + 4 ELSE pos END AS pos, CASE WHEN n - pos >= 3 THEN {four} ELSE h END AS h FROM x1)",
    ]
    for k in range(3, 6):
        steps.append(f"x{k} AS (SELECT {keep}, s, n, CASE WHEN pos <= n THEN pos + 1 ELSE pos END AS pos, CASE WHEN pos <= n THEN {one} ELSE h END AS h FROM x{k - 1})")
    for k, (shift, factor) in enumerate(((33, _P[1]), (29, _P[2])), 6):
        steps.append(f"x{k} AS (SELECT {keep}, {_times(_xor('h', f'h // {1 << shift}::UHUGEINT'), factor)} AS h FROM x{k - 1})")
    steps.append(f"x8 AS (SELECT {keep}, {_xor('h', f'h // {1 << 32}::UHUGEINT')}::HUGEINT AS h FROM x7)")
    steps.append(f"hashed AS (SELECT {keep}, CASE WHEN h >= 9223372036854775808 THEN h - {_ALL} ELSE h END AS h FROM x8)")
    return ", " + ",\n".join(steps)
