"""Smart-meter analytics as Spark jobs.

Readings come in as ``(id, ts, consumption)``.  From past readings and outside
temperature the library builds an hourly expected-consumption model, flags
readings above a fixed limit or above the model, fills sparse series by
copying or by interpolation, and replays datasets at a chosen rate.
"""

__version__ = "0.1.0"
