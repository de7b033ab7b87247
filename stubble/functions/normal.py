"""The normal distribution as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stubble.functions import as_col

# Coefficients of Wichura's algorithm AS 241 (1988), highest power first;
# numerator and denominator near the median, towards the tails, and far out.
_NEAR = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
     13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080),
    (5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867,
     5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0),
)
_TAIL = (
    (7.7454501427834140764e-4, 0.022723844989269184583, 0.24178072517745061177, 1.2704582524523683826,
     3.6478483247632046050, 5.7694972214606914055, 4.6303378461565452959, 1.4234371107496835773),
    (1.0507500716444168432e-9, 5.4759380849953449460e-4, 0.015198666563616457197, 0.14810397642748007459,
     0.68976733498510000455, 1.6763848301838038494, 2.0531916266377588219, 1.0),
)
_FAR = (
    (2.0103343992922881327e-7, 2.7115555687434875782e-5, 1.2426609473880784386e-3, 0.026532189526576123093,
     0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.0442631033899397856e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.8686913114561325910e-4,
     0.014875361290850614853, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def _ratio(coefficients: tuple, r: Column) -> Column:
    top, bottom = (reduce(lambda acc, c: acc * r + F.lit(c), row[1:], F.lit(row[0])) for row in coefficients)
    return top / bottom


def normal_quantile(p) -> Column:
    """The standard normal quantile of a probability; null outside the open interval 0 to 1."""
    x = as_col(p).cast("double")
    q = x - 0.5
    tail = F.sqrt(-F.log(F.least(x, F.lit(1.0) - x)))
    side = F.when(q < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    outer = F.when(tail <= 5, _ratio(_TAIL, tail - 1.6)).otherwise(_ratio(_FAR, tail - 5.0))
    near = q * _ratio(_NEAR, F.lit(0.180625) - q * q)
    return F.when((x > 0) & (x < 1), F.when(F.abs(q) <= 0.425, near).otherwise(side * outer))


def normal_density(z) -> Column:
    """The standard normal density."""
    x = as_col(z)
    return F.exp(-x * x / 2) / F.lit(math.sqrt(2 * math.pi))
