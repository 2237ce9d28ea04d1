"""Business tables with exact decimals (SRC_SQL, JN_FK)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(15,4)"
RATIO = "decimal(10,4)"

# Allowed states.
ORDER_STATUS = ("pending", "partial_filled", "filled", "cancelled", "rejected")
STRATEGY_STATUS = ("draft", "testing", "active", "paused", "stopped")

SCHEMAS = {
    "users": "user_id string, username string, role string, balance " + MONEY,
    "strategies": f"strategy_id string, user_id string, name string, status string, initial_capital {MONEY}, config string",
    "orders": f"order_id string, strategy_id string, user_id string, symbol string, side string, status string, quantity {MONEY}, "
    f"price {MONEY}, total_amount {MONEY}, placed_at timestamp_ntz",
    "positions": f"strategy_id string, symbol string, quantity {MONEY}, avg_cost {MONEY}, market_value {MONEY}",
    "sync_tasks": "task_id string, status string, symbols_total int, start_time timestamp_ntz, end_time timestamp_ntz",
    "system_logs": "log_id bigint, level string, message string, user_id string, created_at timestamp_ntz",
    "app_configs": "config_key string, config_value string, is_active boolean",
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast to the table's schema; missing columns are NULL, unknown ones dropped."""
    out = []
    for part in _fields(SCHEMAS[table]):
        name, kind = part.split(" ", 1)
        out.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


def _fields(schema: str) -> list[str]:
    fields, depth, cur = [], 0, ""
    for ch in schema:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            fields.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*fields, cur.strip()]


def read_table(spark: SparkSession, base: str, table: str) -> DataFrame:
    """A business table stored as Parquet under `base`."""
    return conform(spark.read.parquet(f"{base}/{table}"), table)


def config_value(config, path: str):
    """A field of a JSON configuration column."""
    return F.get_json_object(config, f"$.{path}")
