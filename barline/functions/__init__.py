from .scalars import (
    MINUTE_MS,
    as_double,
    date_text,
    day_bounds_ms,
    div,
    epoch_ms,
    epoch_ms_of,
    finite,
    minute_floor,
    open_time_ms,
    ratio,
    to_bool,
    to_double,
    to_long,
    utc_timestamp,
)
from .schema import (
    base_feature_columns,
    clean_name,
    clean_name_text,
    drawdown_names,
    numeric_columns,
    parse_grid,
    positive_ints,
    require_columns,
    training_columns,
    unit_floats,
)
