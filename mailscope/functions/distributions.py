"""Tail probabilities of the F and t distributions as Spark expressions.

Spark has no incomplete beta function. It is evaluated here on the few rows a test produces, by its
continued fraction, with Spark's own higher-order functions; no Python worker is involved. The
expressions are put together as SQL text, arguments included, because handing over each arithmetic step
as a column object takes longer than evaluating all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the Lanczos approximation of the gamma function for g = 7.
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)

#: From here on the gamma function is taken from Stirling's series, whose main parts cancel on paper.
LARGE = 10

#: An argument so large that a tail has its limiting form, and how far out that is used.
HUGE, NEAR = 100000, 40

#: How near to 1 the last factor of the continued fraction must be; a result that has not settled is NULL, unless
#: the whole tail is smaller than the last digit of a probability.
SETTLED, NOTHING = 1e-11, 1e-16

#: Added where a sum must not be exactly 0; anywhere else it is lost in rounding.
TINY = "1e-300D"


def _log_gamma(z: str) -> str:
    series = " + ".join([f"{LANCZOS[0]!r}D"] + [f"({c!r}D) / ({z} + {i}D)" for i, c in enumerate(LANCZOS[1:])])
    t = f"({z} + {LANCZOS_G - 0.5}D)"
    return f"({0.5 * math.log(2 * math.pi)!r}D + ({z} - 0.5D) * ln{t} - {t} + ln({series}))"


def log_gamma(z: str) -> Column:
    """Logarithm of the gamma function of a SQL expression, for values from 0.5."""
    return F.expr(_log_gamma(f"({z})"))


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _stirling(z: str) -> str:
    """What Stirling's formula leaves out of log gamma, for values from :data:`LARGE`."""
    return f"((1D / 12 - (1D / 360 - (1D / 1260 - 1D / 1680 / ({z} * {z})) / ({z} * {z})) / ({z} * {z})) / {z})"


def _log_front(v: str) -> str:
    """log of z^p w^q / B(p, q) for the arguments ``v.p, v.q, v.z`` and ``v.w`` = 1 - z.

    Three large log gammas would cancel, so their main parts are put together beforehand: with two large
    arguments as distances of z and w from the mean, with one as a logarithm near 1.
    """
    p, q, z, w = (f"{v}.{name}" for name in "pqzw")
    both = (
        f"{p} * log1p(({z} * {q} - {w} * {p}) / {p}) + {q} * log1p(({w} * {p} - {z} * {q}) / {q}) "
        f"+ 0.5D * ln({p} / ({p} + {q}) * {q} / {2 * math.pi!r}D) "
        f"+ {_stirling(f'({p} + {q})')} - {_stirling(p)} - {_stirling(q)}"
    )

    def one(big: str, small: str, at_big: str, log_big: str, log_small: str) -> str:
        total = f"({big} + {small})"
        return (
            f"({big} - 0.5D) * log1p({small} / {big}) + {small} * (ln{total} + {log_small}) - {small} "
            f"+ {_stirling(total)} - {_stirling(big)} - {_log_gamma(small)} + {big} * {log_big}"
        )

    log_z, log_w = f"if({z} > 0.5D, log1p(-{w}), ln({z}))", f"if({w} > 0.5D, log1p(-{z}), ln({w}))"
    none = f"{_log_gamma(f'({p} + {q})')} - {_log_gamma(p)} - {_log_gamma(q)} + {p} * {log_z} + {q} * {log_w}"
    return (
        f"CASE WHEN {p} >= {LARGE} AND {q} >= {LARGE} THEN {both} WHEN {p} >= {LARGE} THEN {one(p, q, z, log_z, log_w)} "
        f"WHEN {q} >= {LARGE} THEN {one(q, p, w, log_w, log_z)} ELSE {none} END"
    )


def _fraction(v: str, front: str) -> str:
    """The continued fraction for the arguments ``v.p, v.q, v.z``, by the modified Lentz method.

    It settles within a number of terms that grows with the square root of the smaller argument.
    """
    p, q, z = f"{v}.p", f"{v}.q", f"{v}.z"

    def step(s: str, term: str) -> str:
        return (
            f"named_struct('c', 1D + {term} / {s}.c + {TINY}, 'd', 1D / (1D + {term} * {s}.d + {TINY}), "
            f"'value', {s}.value * {s}.c * {s}.d)"
        )

    even = f"(m * ({q} - m) * {z} / (({p} + 2D * m - 1D) * ({p} + 2D * m)))"
    odd = f"(-({p} + m) * ({p} + {q} + m) * {z} / (({p} + 2D * m) * ({p} + 2D * m + 1D)))"
    start = f"named_struct('c', 1D, 'd', 1D / (1D - ({p} + {q}) * {z} / ({p} + 1D) + {TINY}), 'value', 1D)"
    pair = _let("half", step("s", even), step("half", odd))
    terms = f"cast(100 + 6 * sqrt(least({p}, {q})) AS INT)"
    settled = f"abs(s.c * s.d - 1D) < {SETTLED!r}D OR {front} < {NOTHING!r}D"
    result = f"s -> if({settled}, s.value * s.c * s.d, NULL)"
    return f"aggregate(sequence(1, {terms}), {start}, (s, m) -> {pair}, {result})"


def _regularised_beta(a: str, b: str, x: str, y: str) -> str:
    """I_x(a, b) for a, b >= 0.5 and y = 1 - x; NULL where an argument is."""
    # The fraction settles fast on one side of the mean; the other side is its complement. With one huge argument
    # the far side loses digits, and the near one, though above its mean, still settles.
    swapped = (
        f"CASE WHEN u.a >= {HUGE} AND u.b < {LARGE} AND u.y * u.a < {NEAR} THEN true "
        f"WHEN u.b >= {HUGE} AND u.a < {LARGE} AND u.x * u.b < {NEAR} THEN false "
        "ELSE u.x > (u.a + 1D) / (u.a + u.b + 2D) END"
    )
    ordered = (
        f"named_struct('swap', {swapped}, 'p', if({swapped}, u.b, u.a), 'q', if({swapped}, u.a, u.b), "
        f"'z', if({swapped}, u.y, u.x), 'w', if({swapped}, u.x, u.y))"
    )
    part = _let("front", f"exp({_log_front('v')}) / v.p", f"front * {_fraction('v', 'front')}")
    tail = _let("v", ordered, _let("part", part, "if(v.swap, 1D - part, part)"))
    cases = f"CASE WHEN u.x <= 0D THEN 0D WHEN u.y <= 0D THEN 1D WHEN u.x IS NOT NULL THEN {tail} END"
    arguments = f"named_struct('a', double({a}), 'b', double({b}), 'x', double({x}), 'y', double({y}))"
    return _let("u", arguments, cases)


def f_upper_tail(f: str, df_between: str, df_within: str) -> Column:
    """P(F >= f), for SQL expressions such as column names."""
    within, between = f"double({df_within})", f"double({df_between}) * ({f})"
    both = f"({within} + {between})"
    return F.expr(_regularised_beta(
        f"{within} / 2", f"double({df_between}) / 2", f"try_divide({within}, {both})", f"try_divide({between}, {both})"
    ))


def t_two_sided(t: str, df: str) -> Column:
    """P(|T| >= |t|), for SQL expressions such as column names."""
    both = f"(({df}) + ({t}) * ({t}))"
    return F.expr(_regularised_beta(
        f"({df}) / 2", "0.5", f"try_divide(double({df}), {both})", f"try_divide(double({t}) * ({t}), {both})"
    ))
