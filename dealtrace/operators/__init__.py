from .aggregate import (
    ad_totals,
    count_by,
    deal_summary,
    drop_null_keys,
    engagement_rates,
    last_n,
    non_null_columns,
    pre_aggregate_deals,
    top_n,
    total,
)
from .incremental import StateStore
from .intervals import TouchIntervals, expand, link_touches, links_by_kind, touch_intervals
from .lookup import lookup_join
from .membership import dictionary, having, listed, marks, memberships, merged
from .reshape import pivot_sum, ranked_pivot, stack_columns
from .state import latest_state
from .sweep import deal_channel_links, in_ranges, touch_links, touch_prefixes

__all__ = [
    "StateStore",
    "TouchIntervals",
    "ad_totals",
    "count_by",
    "deal_channel_links",
    "deal_summary",
    "dictionary",
    "drop_null_keys",
    "engagement_rates",
    "expand",
    "having",
    "in_ranges",
    "last_n",
    "latest_state",
    "link_touches",
    "links_by_kind",
    "listed",
    "lookup_join",
    "marks",
    "memberships",
    "merged",
    "non_null_columns",
    "pivot_sum",
    "pre_aggregate_deals",
    "ranked_pivot",
    "stack_columns",
    "top_n",
    "total",
    "touch_intervals",
    "touch_links",
    "touch_prefixes",
]
