"""ledgerlens: sales-invoice analytics as Spark jobs.

``sources`` loads and cleans the sales lines (and keeps a year-partitioned
snapshot), ``operators`` holds the filters, reports, series features and
forecasts (each ``DataFrame -> DataFrame``), ``functions`` the scalar column
helpers, ``streaming`` the incremental snapshot refresh, and ``plans`` the
registered queries with their SQL twins.
"""

__version__ = "0.1.0"
