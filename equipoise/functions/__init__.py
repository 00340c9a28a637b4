"""Native column expressions: seeded randomness and scalar transforms."""

from equipoise.functions.random import (  # noqa: F401
    hash_normal,
    hash_normal_sql,
    hash_u,
    hash_u_sql,
    poisson1_weight,
    poisson1_weight_sql,
)
from equipoise.functions.scalar import (  # noqa: F401
    clip01,
    days_between,
    parse_date,
    percent_to_double,
    positive_flag,
    target_equals,
    target_positive,
    target_shift,
)
