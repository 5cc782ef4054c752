"""Registration of queries with their DuckDB SQL, and SQL texts of special functions as series."""

from __future__ import annotations

from quillon.operators.rng import splitmix64


class Register:
    """Queries and SQL of a module."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return keep


def gammp(a: str, x: str, terms: int = 400) -> str:
    """Regularised lower incomplete gamma as a power series."""
    return f"(CASE WHEN {x} <= 0 THEN 0.0 ELSE list_sum([exp(j_ * ln({x}) - lgamma({a} + j_ + 1) + {a} * ln({x}) - {x}) FOR j_ IN range(0, {terms})]) END)"


def betai_series(a: str, b: str, x: str, terms: int = 600) -> str:
    """Regularised incomplete beta as a power series; good for x below a / (a + b)."""
    return f"(CASE WHEN {x} <= 0 THEN 0.0 ELSE list_sum([exp(lgamma({a} + {b} + j_) - lgamma({b}) - lgamma({a} + j_ + 1) + ({a} + j_) * ln({x}) + {b} * ln(1 - {x})) FOR j_ IN range(0, {terms})]) END)"


def betai(a: str, b: str, x: str, terms: int = 600) -> str:
    """Regularised incomplete beta from the nearer end."""
    return f"(CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 WHEN {x} < ({a} + 1.0) / ({a} + {b} + 2.0) THEN {betai_series(a, b, x, terms)} ELSE 1 - {betai_series(b, a, f'(1 - {x})', terms)} END)"


def phi(z: str) -> str:
    """The standard normal cdf."""
    return f"(0.5 + 0.5 * sign({z}) * {gammp('0.5', f'(({z}) * ({z}) / 2)', 200)})"


def t_p(t: str, df: str) -> str:
    """Two-sided p-value of Student's t."""
    y = f"(({t}) * ({t}) / ({df} + ({t}) * ({t})))"
    return f"(1 - {betai('0.5', f'({df} / 2)', y)})"


def philox_words(seed: int, tag: int, draws: int, blocks: str) -> str:
    """SQL of a table (draw, word, w): the words of Philox4x32-10 of some draws, blocks x 4 of each, one SELECT for each of the ten rounds."""
    low, key = "4294967295::UBIGINT", splitmix64(seed)
    table = f"SELECT draw, block, block::UBIGINT & {low} AS c0, block::UBIGINT >> 32 AS c1, xor(draw::UBIGINT, {tag}::UBIGINT) & {low} AS c2, xor(draw::UBIGINT, {tag}::UBIGINT) >> 32 AS c3 FROM (SELECT draw, unnest(range(0, {blocks})) AS block FROM (SELECT unnest(range(0, {draws})) AS draw))"
    for i in range(10):
        k0, k1 = (((key >> s) + i * w) & 0xFFFFFFFF for s, w in ((0, 0x9E3779B9), (32, 0xBB67AE85)))
        table = f"""SELECT draw, block, xor(xor(p1 >> 32, c1), {k0}::UBIGINT) AS c0, p1 & {low} AS c1, xor(xor(p0 >> 32, c3), {k1}::UBIGINT) AS c2, p0 & {low} AS c3
            FROM (SELECT *, {0xD2511F53}::UBIGINT * c0 AS p0, {0xCD9E8D57}::UBIGINT * c2 AS p1 FROM ({table}))"""
    return f"SELECT draw, 4 * block + i AS word, [c0, c1, c2, c3][i + 1] AS w FROM ({table}), (SELECT unnest(range(0, 4)) AS i)"


def bootstrap_rows(seed: int, tag: int, draws: int, size: str) -> str:
    """SQL of a table (draw, pos, drawn): what the first words that aren't rejected give, as many as size says."""
    words = philox_words(seed, tag, draws, f"(SELECT {size} // 4 + {size} // 1000 + 16)")
    return f"""SELECT draw, row_number() OVER (PARTITION BY draw ORDER BY word) - 1 AS pos, ((w * {size}::UBIGINT) >> 32)::BIGINT AS drawn FROM ({words})
        WHERE (w * {size}::UBIGINT) & 4294967295::UBIGINT >= 4294967296::UBIGINT % {size}::UBIGINT
        QUALIFY pos < {size}"""
