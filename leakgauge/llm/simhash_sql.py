"""The question of op4 in SQL for another engine: XXH64 step by step, majorities, pairs, reachability.

Values are kept below 2**64 by hand, because the engine's integers do not wrap around.
"""

import string

#: The primes of XXH64, and the seed of the contract.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
SEED, MODULUS = 42, 1 << 64
LANES = {"a": (SEED + P1 + P2) % MODULUS, "b": (SEED + P2) % MODULUS, "c": SEED, "d": (SEED - P1) % MODULUS}


def _reduced(x):
    return f"(({x}) % {MODULUS}::UHUGEINT)::UBIGINT"


def _sum(a, b):
    return _reduced(f"({a})::UHUGEINT + ({b})::UHUGEINT")


def _product(a, b):
    return _reduced(f"({a})::UHUGEINT * {b}::UHUGEINT")


def _turned(x, bits):
    return f"({_reduced(f'({x})::UHUGEINT * {1 << bits}::UHUGEINT')} + (({x}) >> {64 - bits}))"


def _round(state, lane):
    return _product(_turned(_sum(state, _product(lane, P2)), 31), P1)


def _number(at, size):
    """A little-endian number out of the bytes in hexadecimal text hx."""
    return "('0x' || " + " || ".join(f"substr(hx, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(size))) + ")::UBIGINT"


def _steps():
    """(when, then) of every step after the stripes of 32 bytes; `h` is the state before the step."""
    for v in LANES:
        yield "n >= 32", _sum(_product(f"xor(h, {_round('0::UBIGINT', f'v.{v}')})", P1), P4)
    yield "true", _sum("h", "n")
    for k in range(3):
        lane = _round("0::UBIGINT", _number(f"n // 32 * 32 + {8 * k}", 8))
        yield f"n % 32 // 8 > {k}", _sum(_product(_turned(f"xor(h, {lane})", 27), P1), P4)
    yield "n % 8 >= 4", _sum(_product(_turned(f"xor(h, {_product(_number('n // 8 * 8', 4), P1)})", 23), P2), P3)
    for k in range(3):
        yield f"n % 4 > {k}", _product(_turned(f"xor(h, {_product(_number(f'n // 4 * 4 + {k}', 1), P5)})", 11), P1)
    for bits, prime in ((33, P2), (29, P3), (32, 1)):
        yield "true", _product(f"xor(h, h >> {bits})", prime)


def simhash_groups_sql(radius=2):
    stripe = ", ".join(f"{v}: {_number(f'32 * i + {8 * k}', 8)}" for k, v in enumerate(LANES))
    start = ", ".join(f"{v}: {n}::UBIGINT" for v, n in LANES.items())
    mixed = ", ".join(f"{v}: {_round(f'acc.{v}', f'x.{v}')}" for v in LANES)
    merged = " + ".join(f"{_turned(f'v.{v}', r)}::UHUGEINT" for v, r in zip(LANES, (1, 7, 12, 18)))
    ctes, last = [], "step0"
    for k, (when, then) in enumerate(_steps(), start=1):
        ctes.append(f"step{k} AS (SELECT * REPLACE (CASE WHEN {when} THEN {then} ELSE h END AS h) FROM {last})")
        last = f"step{k}"
    ones = ", ".join(f"sum((h >> {b}) & 1) AS s{b}" for b in range(64))
    mark = " + ".join(f"CASE WHEN 2 * s{b} > shingles THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))
    lower = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS words
  FROM (SELECT doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents)
), runs AS (
  SELECT doc_id, pos, words, concat_ws(' ', word, lead(word) OVER along, lead(word, 2) OVER along) AS shingle
  FROM words WINDOW along AS (PARTITION BY doc_id ORDER BY pos)
), shingles AS (
  SELECT doc_id, shingle FROM runs WHERE pos = 1 OR pos <= words - 2
), texts AS (
  SELECT shingle, hex(encode(shingle)) AS hx, strlen(shingle)::BIGINT AS n FROM (SELECT DISTINCT shingle FROM shingles)
), striped AS (
  SELECT *, CASE WHEN n >= 32 THEN list_reduce(
    list_transform(range(n // 32), lambda i: {{{stripe}}}), lambda acc, x: {{{mixed}}}, {{{start}}}) END AS v FROM texts
), step0 AS (
  SELECT *, CASE WHEN n >= 32 THEN {_reduced(merged)} ELSE {(SEED + P5) % MODULUS}::UBIGINT END AS h FROM striped
), {", ".join(ctes)}, counted AS (
  SELECT doc_id, count(*) AS shingles, {ones} FROM shingles JOIN {last} USING (shingle) GROUP BY doc_id
), marked AS (
  SELECT d.doc_id, coalesce({mark}, 0::UBIGINT) AS f FROM documents d LEFT JOIN counted USING (doc_id)
), marks AS (
  SELECT f, min(doc_id) AS least FROM marked GROUP BY f
), links AS (
  SELECT a.f AS a, b.f AS b FROM marks a, marks b WHERE bit_count(xor(a.f, b.f)) <= {radius}
), reach AS (
  SELECT f, f AS r FROM marks UNION SELECT reach.f, links.b FROM reach JOIN links ON reach.r = links.a
), named AS (
  SELECT reach.f, min(least) AS component_id FROM reach JOIN marks ON marks.f = reach.r GROUP BY reach.f
)
SELECT doc_id, lpad(lower(to_hex(f)), 16, '0') AS fingerprint, component_id FROM marked JOIN named USING (f)
"""
