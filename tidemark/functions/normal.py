"""The standard normal distribution as column expressions, to about fifteen digits, and harmonic numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of published rational approximations, lowest power first. Quantile: Wichura (1988), AS 241;
# distribution: Hart (1968), as given by West (2005).
_MIDDLE = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
_MIDDLE_OVER = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
_SIDE = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
_SIDE_OVER = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
_FAR = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
_FAR_OVER = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)
_TAIL = (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 3.52624965998911e-2)
_TAIL_OVER = (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-2)
_EULER = 0.5772156649015328606


def _polynomial(x: Column, powers: tuple[float, ...]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), reversed(powers[:-1]), F.lit(powers[-1]))


def upper_tail(x: Column) -> Column:
    """P(Z > x) for x >= 0."""
    bell = F.exp(-x * x / 2)
    near = bell * _polynomial(x, _TAIL) / _polynomial(x, _TAIL_OVER)
    fraction = reduce(lambda acc, k: x + F.lit(float(k)) / acc, (4, 3, 2, 1), x + 0.65)
    return F.when(x < 7.07106781186547, near).otherwise(bell / fraction / 2.506628274631000502)


def two_sided_p(t: Column) -> Column:
    return F.least(F.lit(1.0), 2 * upper_tail(F.abs(t)))


def upper_quantile(p: Column) -> Column:
    """The x with P(Z > x) = p, for p in (0, 1); null elsewhere. Small p lose no digits."""
    q = F.lit(0.5) - p
    r = F.lit(0.180625) - q * q
    middle = q * _polynomial(r, _MIDDLE) / _polynomial(r, _MIDDLE_OVER)
    s = F.sqrt(-F.log(F.least(p, 1 - p)))
    side = F.when(s <= 5, _polynomial(s - 1.6, _SIDE) / _polynomial(s - 1.6, _SIDE_OVER)).otherwise(_polynomial(s - 5, _FAR) / _polynomial(s - 5, _FAR_OVER))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, middle).otherwise(F.when(q < 0, -side).otherwise(side)))


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: sums up to 31, beyond by the asymptotic series."""
    sums = [sum(1 / k for k in range(1, m + 1)) for m in range(1, 32)]
    x = n.cast("double")
    series = F.log(x) + _EULER + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4.0))) - 1 / (252 * F.pow(x, F.lit(6.0)))
    return F.when(n < 32, F.get(F.array(*map(F.lit, sums)), (n - 1).cast("int"))).otherwise(series)
