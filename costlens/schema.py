"""Column names, types and default parameters of the bill data model."""

from __future__ import annotations

from pyspark.sql import types as T

USAGE_DATE = "usage_date"
SERVICE = "service"
REGION = "region"
RESOURCE = "resource_id"
COST = "cost_usd"
LINE_ID = "line_id"
LINES = "line_count"
MONTH = "month"

# Money is decimal inside the library: decimal sums do not depend on the order
# in which partitions are merged. Reports cast to double as their last step.
# Ten digits behind the point hold usage prices per request; a cost that this
# type cannot hold exactly is rejected on load, never rounded.
MONEY = T.DecimalType(28, 10)

BILL_LINE = T.StructType(
    [
        T.StructField(USAGE_DATE, T.DateType(), False),
        T.StructField(SERVICE, T.StringType(), False),
        T.StructField(REGION, T.StringType(), False),
        T.StructField(RESOURCE, T.StringType(), False),
        T.StructField(COST, MONEY, False),
    ]
)
BILL_COLUMNS = tuple(BILL_LINE.fieldNames())

# Header names of the bill CSV, in file order.
CSV_HEADER = {
    USAGE_DATE: "data",
    SERVICE: "servico",
    REGION: "regiao",
    RESOURCE: "recurso_id",
    COST: "custo_usd",
}

# Weekday labels, Sunday first; the digit makes them sort.
WEEKDAYS_EN = (
    "0-Sunday",
    "1-Monday",
    "2-Tuesday",
    "3-Wednesday",
    "4-Thursday",
    "5-Friday",
    "6-Saturday",
)
WEEKDAYS_PT = (
    "0-Domingo",
    "1-Segunda",
    "2-Terça",
    "3-Quarta",
    "4-Quinta",
    "5-Sexta",
    "6-Sábado",
)

# Defaults of the report and alert parameters.
COMPLETE_MONTH_DAYS = 20
TOP_RESOURCES = 10
GROWTH_THRESHOLD_PCT = 20.0
OUTLIER_TOP_N = 3
OUTLIER_STD_FACTOR = 2.0
OUTLIER_MIN_RESOURCES = 3
FORECAST_DAYS = 30
TAIL_DAYS = 30
ALERT_CARDS = 5
PROJECTION_RED_PCT = 10.0
