"""Timetable analytics on Spark: GTFS feeds, travel steps, profiles, graphs and tours as DataFrames."""
