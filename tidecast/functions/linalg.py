"""Closed-form least squares from centred moments, as column expressions.

Input columns (per model row): ``c{i}{j}`` = covar_pop(x_i, x_j) for i <= j,
``b{i}`` = covar_pop(x_i, y), ``m{i}`` = avg(x_i), ``my`` = avg(y).
Normal equations ``C w = b`` are solved by Gaussian elimination without
row exchange (C is symmetric positive semi-definite, so the trailing block
stays symmetric and only the upper triangle is carried).  A pivot that has
lost all but ``1e-12`` of its original diagonal is treated as zero: that
coefficient is 0 and its row is not used, which gives a basic solution.  It
fits the training rows like any other solution, but rows outside their span
(serving features) need the one of least norm.  So every dropped pivot also
gives a vector of the null space, by back substitution; the vectors are made
orthogonal to each other and the solution is projected off them.  A constant
slot (the long tier's fourth) gets exactly 0.0.

The stages are plain SQL expression text so the same algebra runs in Spark
(``F.expr``, whole-stage codegen) and in any SQL engine used to check it.
Each stage only references columns of earlier stages, so Spark keeps one
projection per stage instead of inlining a tree that grows with every
pivot.
"""

from __future__ import annotations

PIVOT_TOLERANCE = 1e-12


def _a(k: int, i: int, j: int, sfx: str = "") -> str:
    i, j = min(i, j), max(i, j)
    return f"c{i}{j}{sfx}" if k == 0 else f"a{k}_{i}{j}{sfx}"


def _r(k: int, i: int, sfx: str = "") -> str:
    return f"b{i}{sfx}" if k == 0 else f"r{k}_{i}{sfx}"


def _ok(k: int, tol: float, sfx: str = "") -> str:
    return f"{_a(k, k, k, sfx)} > {tol!r} * c{k}{k}{sfx}"


def solve_stages(p: int = 4, tol: float = PIVOT_TOLERANCE, suffix: str = "") -> list[list[tuple[str, str]]]:
    """Stages of ``(name, sql_expression)``; the last stages yield
    ``w0..w{p-1}`` and ``intercept``.  ``suffix`` is appended to every
    column read or written, so several systems can be solved side by side."""
    x = suffix
    stages: list[list[tuple[str, str]]] = []
    for k in range(p - 1):
        piv = _a(k, k, k, x)
        ok = _ok(k, tol, x)
        stage = []
        for i in range(k + 1, p):
            for j in range(i, p):
                stage.append((_a(k + 1, i, j, x),
                              f"CASE WHEN {ok} THEN {_a(k, i, j, x)} - {_a(k, k, i, x)} * {_a(k, k, j, x)} / {piv} "
                              f"ELSE {_a(k, i, j, x)} END"))
            stage.append((_r(k + 1, i, x),
                          f"CASE WHEN {ok} THEN {_r(k, i, x)} - {_a(k, k, i, x)} * {_r(k, k, x)} / {piv} "
                          f"ELSE {_r(k, i, x)} END"))
        stages.append(stage)
    for k in reversed(range(p)):
        piv = _a(k, k, k, x)
        rest = "".join(f" - {_a(k, k, j, x)} * w{j}{x}" for j in range(k + 1, p))
        stages.append([(f"w{k}{x}", f"CASE WHEN {_ok(k, tol, x)} THEN ({_r(k, k, x)}{rest}) / {piv} ELSE 0.0 END")])
    stages += _least_norm_stages(p, tol, x)
    stages.append([(f"intercept{x}", f"my{x}" + "".join(f" - w{i}{x} * m{i}{x}" for i in range(p)))])
    return stages


def _least_norm_stages(p: int, tol: float, x: str) -> list[list[tuple[str, str]]]:
    """Null-space vectors ``v{k}_{i}`` (all 0 where pivot k holds), orthogonalised
    as ``q{k}_{i}`` with squared length ``qq{k}``, and ``w`` projected off them."""
    def dot(a: list[str], b: list[str]) -> str:
        return "(" + " + ".join(f"{s} * {t}" for s, t in zip(a, b, strict=True)) + ")"

    stages: list[list[tuple[str, str]]] = []
    for k in range(p):
        lost = f"NOT ({_ok(k, tol, x)})"
        stages.append([(f"v{k}_{i}{x}", f"CASE WHEN {lost} THEN 1.0 ELSE 0.0 END" if i == k else "0.0") for i in range(k, p)])
        for i in reversed(range(k)):  # rows below a kept pivot, solved upwards; other dropped pivots stay 0
            rest = " + ".join(f"{_a(i, i, j, x)} * v{k}_{j}{x}" for j in range(i + 1, k + 1))
            stages.append([(f"v{k}_{i}{x}", f"CASE WHEN {lost} AND {_ok(i, tol, x)} THEN -({rest}) / {_a(i, i, i, x)} "
                                            f"ELSE 0.0 END")])
    for k in range(p):
        own = [f"v{k}_{i}{x}" for i in range(p)]
        stage = [(f"t{k}_{j}{x}", f"CASE WHEN qq{j}{x} > 0 THEN {dot(own, [f'q{j}_{i}{x}' for i in range(p)])} / qq{j}{x} "
                                  f"ELSE 0.0 END") for j in range(k)]
        if stage:
            stages.append(stage)
        stages.append([(f"q{k}_{i}{x}", own[i] + "".join(f" - t{k}_{j}{x} * q{j}_{i}{x}" for j in range(k))) for i in range(p)])
        stages.append([(f"qq{k}{x}", dot(*[[f"q{k}_{i}{x}" for i in range(p)]] * 2))])
    w = [f"w{i}{x}" for i in range(p)]
    stages.append([(f"s{k}{x}", f"CASE WHEN qq{k}{x} > 0 THEN {dot(w, [f'q{k}_{i}{x}' for i in range(p)])} / qq{k}{x} "
                                f"ELSE 0.0 END") for k in range(p)])
    stages.append([(f"w{i}{x}", f"w{i}{x}" + "".join(f" - s{k}{x} * q{k}_{i}{x}" for k in range(p))) for i in range(p)])
    return stages


def temp_columns(p: int = 4, suffix: str = "") -> list[str]:
    """Intermediate names produced by ``solve_stages`` (to drop afterwards)."""
    kept = {f"w{i}{suffix}" for i in range(p)} | {f"intercept{suffix}"}
    names: dict[str, None] = {}
    for stage in solve_stages(p, suffix=suffix):
        names.update(dict.fromkeys(n for n, _ in stage if n not in kept))
    return list(names)


def moment_names(p: int = 4, suffix: str = "") -> list[str]:
    return ([f"c{i}{j}{suffix}" for i in range(p) for j in range(i, p)]
            + [f"b{i}{suffix}" for i in range(p)] + [f"m{i}{suffix}" for i in range(p)] + [f"my{suffix}"])


def prediction_sql(p: int = 4, prefix: str = "", suffix: str = "") -> str:
    """``intercept + sum w_i * x_i``."""
    return f"{prefix}intercept{suffix}" + "".join(f" + {prefix}w{i}{suffix} * x{i}{suffix}" for i in range(p))
