"""Column-level functions (all JVM-side expressions)."""

from .dates import format_version_date, iso_utc, parse_version_date, utc_wall_clock
from .embed import hash_embed, tokens
from .keys import cache_key, full_model_name, model_parts, parse_key
from .text import first_token, newline_to_space, strip_ws, text_validity
from .vectors import squared_l2

__all__ = [
    "format_version_date", "iso_utc", "parse_version_date", "utc_wall_clock",
    "hash_embed", "tokens", "cache_key", "full_model_name", "model_parts",
    "parse_key", "first_token", "newline_to_space", "strip_ws",
    "text_validity", "squared_l2",
]
