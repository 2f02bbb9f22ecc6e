"""Shapiro-Wilk W and its p-value (Royston 1995) from grouped sums, as SQL text over one row per column.

W needs, of the expected normal order statistics m_i = PPF((i - 0.375) / (n + 0.25)) and the ordered values x_i, only
sum(m_i^2), sum(m_i x_i), sum((x_i - mean)^2) and the two smallest and largest values. The sums cover
all rows. The published p-value approximation holds for n <= 5000; beyond that the p-value is null.
"""

from __future__ import annotations

from ..functions.exprs import normal_tail_steps, polynomial_sql

# Royston's polynomials, ascending powers.
LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
MU_SMALL, SD_SMALL = (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322)
MU_LARGE, SD_LARGE = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
MAX_N = 5000

#: Steps of names and expressions, each over the columns before it. Input: n, mm, mx, ss (sums) and x1, x2, y2, y1
#: (smallest, second, second largest, largest value), m1, m2 (largest and second largest m).
STEPS = [
    {"u": "1 / sqrt(n)"},
    {"a1": f"m1 / sqrt(mm) + {polynomial_sql(LAST, 'u')}", "a2": f"m2 / sqrt(mm) + {polynomial_sql(SECOND, 'u')}"},
    {"phi": "CASE WHEN n > 5 THEN (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2) "
            "ELSE (mm - 2 * m1 * m1) / (1 - 2 * a1 * a1) END"},
    {"top": "CASE WHEN n > 5 THEN (mx - m1 * (y1 - x1) - m2 * (y2 - x2)) / sqrt(phi) + a1 * (y1 - x1) + a2 * (y2 - x2) "
            "ELSE (mx - m1 * (y1 - x1)) / sqrt(phi) + a1 * (y1 - x1) END"},
    {"w": "CASE WHEN y1 = x1 THEN 1.0 ELSE least(1.0, top * top / ss) END"},
    {"lw": "ln(greatest(1 - w, 1e-300))", "ln_n": "ln(n)"},
    {"inner_": "0.459 * n - 2.273 - lw"},
    {"z": "CASE WHEN n <= 11 THEN (-ln(greatest(inner_, 1e-300)) - "
          f"{polynomial_sql(MU_SMALL, 'n')}) / exp({polynomial_sql(SD_SMALL, 'n')}) "
          f"ELSE (lw - {polynomial_sql(MU_LARGE, 'ln_n')}) / exp({polynomial_sql(SD_LARGE, 'ln_n')}) END"},
    *normal_tail_steps("z", "tail"),
    {"w_p": f"CASE WHEN n > {MAX_N} THEN NULL WHEN w >= 1 THEN 1.0 WHEN n <= 11 AND inner_ <= 0 THEN 0.0 ELSE tail END"},
]
