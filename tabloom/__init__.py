"""tabloom: prepare, profile, join and summarise unfamiliar tables with Spark DataFrames."""

__version__ = "0.1.0"
