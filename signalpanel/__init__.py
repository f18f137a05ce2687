"""signalpanel: Spark-native operators for leakage-safe panels of text, events and prices.

Public functions take and return DataFrames (or build Columns); nothing inside an operator
collects data that grows with the input to the driver.
"""
