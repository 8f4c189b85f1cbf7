"""PySpark-native analytics for panels of time series.

A panel is a table of (entity, ts) rows with one column per indicator. Every operator takes and returns
DataFrames; nothing is collected on the driver.
"""
