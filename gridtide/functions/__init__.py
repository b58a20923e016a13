"""Column functions: every one builds a JVM-side expression."""

from gridtide.functions.keys import composite_key, date_parts, epoch_millis, key_columns
from gridtide.functions.render import bracket_row, message_row, tuple_row
from gridtide.functions.text import byte_text, count_text, duration_text, iso_time_text, number_text
from gridtide.functions.weather import adjusted, band_factor, celsius

__all__ = [
    "adjusted",
    "band_factor",
    "bracket_row",
    "byte_text",
    "celsius",
    "composite_key",
    "count_text",
    "date_parts",
    "duration_text",
    "epoch_millis",
    "iso_time_text",
    "key_columns",
    "message_row",
    "number_text",
    "tuple_row",
]
