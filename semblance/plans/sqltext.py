"""SQL fragments for the oracle: the same hash randomness and row keys as the library."""

from __future__ import annotations

from semblance.functions import special
from semblance.functions.rand import MIX, SECOND_CHAIN

WORD = "4294967296.0::double"
WIDE = "4503599627370496.0::double"


def key(*cols: str) -> str:
    return "concat_ws('-', " + ", ".join(f"cast({c} AS varchar)" for c in cols) + ")"


def digest(seed: str | int, k: str) -> str:
    return f"md5(concat_ws(':', '{seed}', cast({k} AS varchar)))"


def word(seed: str | int, k: str, lane: int = 0) -> str:
    return f"('0x' || substr({digest(seed, k)}, {1 + 8 * lane}, 8))::bigint"


def uniform(seed: str | int, k: str, lane: int = 0) -> str:
    return f"({word(seed, k, lane)} / {WORD})"


def uniform_open(seed: str | int, k: str, lane: int = 0) -> str:
    return f"(({word(seed, k, lane)} + 0.5::double) / {WORD})"


def normal(seed: str | int, k: str) -> str:
    return f"(sqrt(-2.0::double * ln({uniform_open(seed, k, 0)})) * cos(2 * pi() * {uniform_open(seed, k, 1)}))"


def numbered(source: str, seed: str | int, k: str) -> str:
    """Rows of a source with idx = 0.. in (hash, key) order."""
    return f"SELECT *, row_number() OVER (ORDER BY {digest(seed, k)}, {k}) - 1 AS idx FROM {source}"


def index(seed: str | int, k: str, n: str | int) -> str:
    """Uniform integer in [0, n) from the first 52 bits of the digest."""
    return f"cast(floor(('0x' || substr({digest(seed, k)}, 1, 13))::bigint / {WIDE} * {n}) AS bigint)"


def draw(seed: str | int, k: str, n: str) -> str:
    return index(f"{seed}/draw", k, n)


def split(source: str, k: str, share: float = 0.2, seed: int = 42, by: str | None = None) -> str:
    """Rows with is_test = among the first ceil(share * n) by (hash, key), per class if given."""
    part = f"PARTITION BY {by}" if by else ""
    return (
        f"SELECT *, row_number() OVER ({part} ORDER BY {digest(seed, k)}, {k}) "
        f"<= ceil(round({share} * count(*) OVER ({part}), 9)) AS is_test FROM {source}"
    )


LINE_KEY = key("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cast(round(l_extendedprice * 100) AS bigint)")
LINE = f"SELECT *, {LINE_KEY} AS k FROM lineitem"


def _poly(coef, r: str) -> str:
    out = repr(coef[-1]) + "::double"
    for c in reversed(coef[:-1]):
        out = f"({out} * {r} + {c!r}::double)"
    return out


def probit(p: str) -> str:
    """Inverse normal CDF of a SQL expression."""
    q, c = f"({p} - 0.5)", special
    r0 = f"({c.PROBIT_CONST} - {q} * {q})"
    tail = f"sqrt(-ln(least({p}, 1 - {p})))"
    near, far = f"({tail} - 1.6)", f"({tail} - 5.0)"
    return (
        f"CASE WHEN abs({q}) <= {c.PROBIT_SPLIT} THEN {q} * {_poly(c.PROBIT_A, r0)} / {_poly(c.PROBIT_B, r0)} "
        f"WHEN {tail} <= 5.0 THEN sign({q}) * {_poly(c.PROBIT_C, near)} / {_poly(c.PROBIT_D, near)} "
        f"ELSE sign({q}) * {_poly(c.PROBIT_E, far)} / {_poly(c.PROBIT_F, far)} END"
    )


def _mixed(x: str) -> str:
    for shift, factor in MIX:
        x = f"list_transform([{x}], lambda y: (xor(y, y >> {shift}) * {factor}::ubigint) & 4294967295::ubigint)[1]"
    return x


def counter_base(seed: int, row: str, chain: int = 0) -> str:
    """One chain of the block draws for a row, as an unsigned word."""
    start = _mixed(f"{seed ^ (SECOND_CHAIN if chain else 0)}::ubigint")
    return _mixed(f"xor({_mixed(f'xor({start}, ({row})::ubigint & 4294967295::ubigint)')}, ({row})::ubigint >> 32)")


def counter_uniform(base: str, at: str | int) -> str:
    """Uniform on (0, 1) of a chain at a counter."""
    return f"((({_mixed(f'xor({base}, ({at})::ubigint)')})::double + 0.5::double) / {WORD})"


def counter_normal(base: str, second: str, at: str | int) -> str:
    return f"(sqrt(-2.0::double * ln({counter_uniform(base, at)})) * cos(2 * pi() * {counter_uniform(second, at)}))"
