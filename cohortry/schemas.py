"""Column layouts of the engine's own tables and of the source files."""

from __future__ import annotations

SEGMENTS = (
    "segment_id int, name string, description string, is_active boolean, "
    "conditions_serialized string, refresh_mode string, cron_expression string, "
    "customer_count bigint, last_refreshed timestamp_ntz, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
MEMBERSHIP = "segment_id int, customer_id bigint, assigned_at timestamp_ntz"
SEGMENT_LOG = "segment_id int, action string, details string, created_at timestamp_ntz"

# Declared instead of inferred: inference would open files once more per read.
SOURCE_FILES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
}
