"""Structured Streaming jobs built from the batch operators."""

from gridtide.streaming.detect import detect_each_batch, detect_stream
from gridtide.streaming.interpolate import interpolate_each_batch
from gridtide.streaming.late import divert_late
from gridtide.streaming.replay import replay, store_slots
from gridtide.streaming.run import (
    run_measured,
    records_per_trigger,
    run_to_end,
    spread,
    start,
    trigger,
)

__all__ = [
    "detect_each_batch",
    "detect_stream",
    "divert_late",
    "interpolate_each_batch",
    "replay",
    "run_measured",
    "records_per_trigger",
    "run_to_end",
    "spread",
    "start",
    "store_slots",
    "trigger",
]
