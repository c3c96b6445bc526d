from gapweave.functions.aggregates import strict_sum, sum0, total_of_distinct
from gapweave.functions.intervals import ci, lognormal_limits, normal_limits, z_value
from gapweave.functions.scalars import (
    cv,
    genlogit,
    geninvlogit,
    log_positive,
    log_sd,
    percent_difference,
    var_from_cv,
)

__all__ = [
    "ci",
    "cv",
    "geninvlogit",
    "genlogit",
    "log_positive",
    "log_sd",
    "lognormal_limits",
    "normal_limits",
    "percent_difference",
    "strict_sum",
    "sum0",
    "total_of_distinct",
    "var_from_cv",
    "z_value",
]
