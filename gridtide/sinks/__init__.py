"""Where results go: files, topics, published models."""

from gridtide.sinks.targets import Target, file_target, topic_target, write_batch
from gridtide.sinks.published import publish_model, save_model
from gridtide.sinks.split import noted_batches, write_split, write_with_totals

__all__ = [
    "Target",
    "file_target",
    "noted_batches",
    "publish_model",
    "save_model",
    "topic_target",
    "write_batch",
    "write_split",
    "write_with_totals",
]
