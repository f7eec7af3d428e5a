"""SQL of tail probabilities for the oracles: power series in gamma functions, unlike the plans' continued fractions."""


def gamma_tail(a: str, x: str) -> str:
    """Regularised upper incomplete gamma function, to about 1e-10."""
    series = f"list_sum(list_transform(generate_series(0, 1500), lambda k_: exp(k_ * ln({x}) + ({a}) * ln({x}) - ({x}) - lgamma(({a}) + k_ + 1))))"
    return f"CASE WHEN ({x}) <= 0 THEN 1.0 WHEN ({x}) > 700 THEN 0.0 ELSE 1 - {series} END"


def chi2_p(x: str, df: str = "1") -> str:
    return gamma_tail(f"({df}) / 2.0", f"({x}) / 2.0")


def normal_p(z: str) -> str:
    return gamma_tail("0.5", f"({z}) * ({z}) / 2.0")


def t_p(t: str, df: str) -> str:
    """Two-sided tail of Student's t."""
    y = f"(({t}) * ({t}) / (({df}) + ({t}) * ({t})))"
    series = f"list_sum(list_transform(generate_series(0, 3000), lambda k_: exp((0.5 + k_) * ln({y}) + ({df}) / 2.0 * ln(1 - {y}) + lgamma(({df}) / 2.0 + 0.5 + k_) - lgamma(1.5 + k_) - lgamma(({df}) / 2.0))))"
    return f"CASE WHEN ({t}) = 0 THEN 1.0 WHEN ({t}) * ({t}) > 1500 AND ({df}) > 100 THEN 0.0 ELSE 1 - {series} END"


def yates_sql(source: str, yes: str, no: str, key: str = "") -> str:
    """A table `yates` of (key, chi2): Yates-corrected chi-square over the two rows of a key in `source`."""
    by, keyed = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    return f"""yates0 AS (SELECT {by}min({yes})::DOUBLE AS a, min_by({no}, {yes})::DOUBLE AS b, max({yes})::DOUBLE AS c, max_by({no}, {yes})::DOUBLE AS d, count(*) AS k, count(DISTINCT {yes}) AS own, min({no})::DOUBLE AS b0, max({no})::DOUBLE AS d0 FROM {source} {keyed}),
yates1 AS (SELECT * REPLACE (CASE WHEN own = 1 THEN b0 ELSE b END AS b, CASE WHEN own = 1 THEN d0 ELSE d END AS d) FROM yates0 WHERE k = 2),
yates AS (SELECT {by}(a + b + c + d) * pow(greatest(abs(a * d - b * c) - (a + b + c + d) / 2, 0), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) AS chi2 FROM yates1 WHERE (a + b) * (c + d) * (a + c) * (b + d) > 0)"""
