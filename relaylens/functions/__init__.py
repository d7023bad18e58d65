from relaylens.functions.columns import (
    MONEY,
    MONEY_TOTAL,
    epoch_micros,
    floor_div,
    metric_value,
    micros_to_ts,
    money,
    rate,
    sum_money,
)

__all__ = [
    "MONEY",
    "MONEY_TOTAL",
    "epoch_micros",
    "floor_div",
    "metric_value",
    "micros_to_ts",
    "money",
    "rate",
    "sum_money",
]
