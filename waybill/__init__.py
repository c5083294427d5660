"""Waybill: travel-booking records, lookups and ledgers as Spark DataFrames."""
