"""Column -> Column expressions. All of them are stateless."""

from patronvoice.functions.bins import (
    COST_TIERS,
    RATING_STARS,
    RATING_TIERS,
    bin_cost_tier,
    bin_rating_star,
    bin_rating_tier,
    cut_right_closed,
    equal_width_bin,
)
from patronvoice.functions.nested import (
    REVIEWS_TYPE,
    keyword_weight_map,
    map_items_top,
    parse_reviews,
    review_count,
    review_texts,
    stringify_nested,
)
from patronvoice.functions.numbers import (
    coerce_numeric,
    negative_to_null,
    parse_count,
    parse_money,
    parse_rating,
    range_to_null,
    round_half_even,
)
from patronvoice.functions.scores import (
    complement_pct,
    has_reviews,
    neutral_threshold,
    popularity_score,
    rice_score,
    signed_score,
)
from patronvoice.functions.text import (
    clean_review_text,
    derive_label,
    encode_yes_no,
    has_min_tokens,
    highlight_matches,
    join_keywords,
    normalize_list_spacing,
    null_tokens_to_null,
    primary_value,
    search_predicate,
    short_name,
    split_keywords,
    strip_text,
    title_case_clean,
    token_count,
    topic_short_name,
    truncate_for_model,
    unescape_newline,
)

__all__ = [name for name in dir() if not name.startswith("_")]
