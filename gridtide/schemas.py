"""Declared schemas; nothing is inferred unless the caller asks for it."""

from pyspark.sql import types as T

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

# The columns of header-less files, by position.
CONSUMPTION_COLUMNS = ["id", "timestamp", "consumption"]
CONSUMPTION_CSV = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("consumption", T.DoubleType()),
    ]
)

WEATHER_CSV = T.StructType(
    [
        T.StructField("temperature", T.DoubleType()),
        T.StructField("icon", T.StringType()),
        T.StructField("humidity", T.DoubleType()),
        T.StructField("visibility", T.DoubleType()),
        T.StructField("summary", T.StringType()),
        T.StructField("apparentTemperature", T.DoubleType()),
        T.StructField("pressure", T.DoubleType()),
        T.StructField("windSpeed", T.DoubleType()),
        T.StructField("cloudCover", T.DoubleType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("windBearing", T.DoubleType()),
        T.StructField("precipIntensity", T.DoubleType()),
        T.StructField("dewPoint", T.DoubleType()),
        T.StructField("precipProbability", T.DoubleType()),
    ]
)
