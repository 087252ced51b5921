"""The registered queries: Spark side, SQL side and the tables with planted defects."""
